"""Secret scans with multipart credential linking, in DataFrame functions only.

Parts. Base parts stand alone: assignments of values of 8+ characters to secret-like names, access identifiers of 16+
and hex runs of 32+ characters. Weak parts mean nothing alone: values of 4+ characters assigned to broader names, user
and client identifiers, and endpoints (scheme://host, hosts assigned to names like host or server, host:port).

Linking. A text falls into scopes at blank lines. Two parts of a scope are near if their spans, widened by REACH code
points, meet. The interval join runs as two sorted passes over a scope's parts (running nearest end before, nearest
start after, for each role), so it costs n log n and never makes pairs. A weak part is reported if a complementary part
is near it and no base part overlaps it. An endpoint goes with any identifier or secret; an identifier and a secret go
together if one of them is a base part. A weak identifier and a weak secret without an endpoint are not reported.

Positions (code points, end exclusive) are running sums of the lengths of matches and of the gaps between them.
Parts are shuffled by row; texts are not.

Defined results: null text is the empty text, which has no parts; repeated rows are scanned each (rows are told apart
by a row number of the scan); null doc_id stays null; further columns are ignored (scan) or pass through (redact);
empty tables give no rows; a text of any length, also of blank lines or one long value alone, is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.quality import let

REACH = 300
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
HOST = r"(?:(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z0-9-]{1,63}|localhost)"
NAMED_HOST = r"(?i:host(?:_?name)?|server|endpoint|domain|url|addr(?:ess)?)"
ENDPOINT = "|".join(
    (
        r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[A-Za-z0-9._~-]{1,253}(?::[0-9]{1,5})?",
        rf"{NAMED_HOST}{VALUE}{HOST}(?::[0-9]{{1,5}})?",
        rf"""{NAMED_HOST}["']?\x20*=\x20*["']?[A-Za-z0-9-]{{1,63}}(?![A-Za-z0-9+.-]*://)(?::[0-9]{{1,5}})?""",
        r"(?<![A-Za-z0-9.@-])(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}:[0-9]{1,5}(?![0-9])",
    )
)
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){VALUE}([A-Za-z0-9+/_.=-]+)"
#: kind -> (pattern, role), in the order that ties of start take. Base kinds come first.
KINDS = {
    "assign": (ASSIGN, "secret"),
    "access": (r"AKIA[A-Z0-9]{12,}", "identifier"),
    "hex": (r"[0-9a-f]{32,}", "secret"),
    "weak_id": (rf"(?i:(?<!secret_|secret)access_?key(?:_?id)?|client_?id|user(?:name|_?id)?|login|account){VALUE}[A-Za-z0-9._@-]{{3,}}", "identifier"),
    "weak_secret": (rf"(?i:pass(?:word|wd)?|pwd|secret|token|credentials?|private_?key|auth|signature|(?:api_?|secret_?access_?)?key){VALUE}[A-Za-z0-9+/_.=@!-]{{4,}}", "secret"),
    "endpoint": (ENDPOINT, "endpoint"),
}
BASE = ("assign", "access", "hex")
ROLES = ("identifier", "secret", "endpoint")
LEAST_VALUE = 8
#: Possessive runs of single classes: a group in a loop would recurse in Java's matcher, once for each blank line.
SCOPE_BREAK = r"\n[ \t\r]*+\n[ \t\r\n]*+"
PART = "struct<kind:int,i:int,gap:int,len:int,breaks:int,ok:boolean>"


def parts_of(text: Column) -> Column:
    """The parts of a text, each with the length of the gap before it in its kind's matches."""

    def of_kind(number: int, kind: str) -> Column:
        pattern = KINDS[kind][0]

        def both(gaps: Column) -> Column:
            def made(found: Column) -> Column:
                ok = (lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 1)) >= LEAST_VALUE) if kind == "assign" else (lambda m: F.lit(True))
                return F.transform(
                    found,
                    lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len"), F.regexp_count(F.get(gaps, i), F.lit(SCOPE_BREAK)).alias("breaks"), ok(m).alias("ok")),
                )

            return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)

        return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), both)).otherwise(F.expr(f"cast(array() as array<{PART}>)"))

    return F.concat(*(of_kind(i, k) for i, k in enumerate(KINDS)))


def has_parts(text: Column) -> Column:
    """Whether a text has a base part or an endpoint."""
    return text.rlike(ASSIGN) | text.rlike(KINDS["access"][0]) | text.rlike(KINDS["hex"][0]) | text.rlike(ENDPOINT)


def find(docs: DataFrame, *carry: str) -> DataFrame:
    """(own, spans, n_linked) of each row: own holds the carried columns, spans sorted (start, kind number, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*(F.col(f"`{c}`") for c in carry))
    # One row for the text itself, and one for each part.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("own"), parts_of(text).alias("parts"))
    rows = rows.select("row", "own", F.posexplode_outer("parts").alias("at", "part"))
    rows = rows.select("row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).alias("own"), "part.*").repartition(F.col("row"))
    order = W.partitionBy("row", "kind").orderBy("i")
    placed = rows.withColumns({"end": F.sum(F.col("gap") + F.col("len")).over(order), "scope": F.sum("breaks").over(order)})
    placed = placed.withColumn("start", F.col("end") - F.col("len"))
    role = F.element_at(F.array(*(F.lit(r) for _, r in KINDS.values())), F.col("kind") + 1)
    is_base = F.col("ok") & (F.col("kind") < len(BASE))
    back = W.partitionBy("row", "scope").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("role", role)
    near = {}
    for r in ROLES:
        mine = F.col("ok") & (F.col("role") == r)
        near[f"{r}_back"] = F.max(F.when(mine, F.col("end"))).over(back)
        near[f"{r}_ahead"] = F.min(F.when(mine, F.col("start"))).over(ahead)
        near[f"base_{r}_back"] = F.max(F.when(mine & is_base, F.col("end"))).over(back)
        near[f"base_{r}_ahead"] = F.min(F.when(mine & is_base, F.col("start"))).over(ahead)
    near["base_back"] = F.max(F.when(is_base, F.col("end"))).over(back)
    near["base_ahead"] = F.min(F.when(is_base, F.col("start"))).over(ahead)
    linked = placed.withColumns(near)
    for r in (*ROLES, "base_identifier", "base_secret"):
        close = (F.col(f"{r}_back") >= F.col("start") - REACH) | (F.col(f"{r}_ahead") <= F.col("end") + REACH)
        linked = linked.withColumn(r, F.coalesce(close, F.lit(False)))
    free = ~F.coalesce((F.col("base_back") > F.col("start")) | (F.col("base_ahead") < F.col("end")), F.lit(False))
    role = F.col("role")
    linked_base = F.when(role == "identifier", F.col("secret")).otherwise(F.col("identifier")) | F.col("endpoint")
    partner = F.when(role == "endpoint", F.col("identifier") | F.col("secret")).otherwise(F.when(role == "identifier", F.col("base_secret")).otherwise(F.col("base_identifier")) | F.col("endpoint"))
    shown = F.col("ok") & ((F.col("kind") < len(BASE)) | (partner & free))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind").alias("kind"), F.col("end").cast("long").alias("end"))
    full = F.col("ok") & (F.col("kind") < len(BASE)) & linked_base
    # `own` may itself be a struct of nulls, so its row is told by the part number.
    return linked.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list(F.when(shown, span))).alias("spans"), F.count(F.when(full, 1)).alias("n_linked")).select("own", "spans", "n_linked")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base parts, base_sha256, all spans, and how many base and weak parts are linked."""
    found = find(docs, "doc_id")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == list(KINDS).index(kind))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        F.col("own.doc_id").cast("long").alias("doc_id"),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.col("n_linked").alias("n_base_linked"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_weak"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span replaced by its kind in brackets (overlapping spans: the first's kind, up to the last end), n_chars anew."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = find(docs.where(has_parts(text)), *docs.columns)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.expr("cast(array() as array<string>)").alias("out"))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def cut(a: Column, s: Column) -> Column:
        before = F.substring(F.col("own.text"), (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int"))
        new = F.struct(s["end"].alias("end"), F.concat(a["out"], F.array(before, F.element_at(names, s["kind"] + 1))).alias("out"))
        return F.when(s["start"] >= a["end"], new).otherwise(F.struct(F.greatest(a["end"], s["end"]).alias("end"), a["out"].alias("out")))

    def rest(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(F.col("own.text"), (a["end"] + 1).cast("int"), F.lit(2**31 - 1)))

    untouched = F.size("spans") == 0
    new = F.aggregate("spans", start, cut, rest)

    def column(name: str) -> Column:
        old = F.col(f"own.`{name}`")
        if name == "text":
            return F.when(untouched, old).otherwise(new).alias(name)
        if name == "n_chars":
            return F.when(untouched, old).otherwise(F.length(new).cast(docs.schema[name].dataType)).alias(name)
        return old.alias(name)

    done = found.select(*(column(c) for c in docs.columns))
    return docs.where(~has_parts(text)).union(done)
