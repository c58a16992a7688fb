"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Measures. Words are runs of characters other than the six ASCII white-space characters; all counts are per text.
Base rules reject texts of under ten words and texts with over a fifth of their words inside repeated 5-word windows.

Cutoffs. Each further rule rejects texts whose measure is at or above a cutoff. On the labelled rows that the base
rules keep and whose label is good, a cutoff's false rejections are binomial; a cutoff is certified if the exact
binomial tail P(X <= false rejections | n, risk) is at most delta / (rules x strata) (Bonferroni). Along one rule's
grid the tests run from the mildest cutoff on and end with the first that fails (fixed sequence, which costs no further
correction), and the last certified one is taken. The risks of a stratum's rules sum to `risk`, so with probability
1 - delta no stratum loses more than that share of its good texts. A stratum with too few labels keeps everything.

Counting is one aggregation by stratum; what reaches the driver is a row per stratum and rule (strata come from a
fixed list). Applying cutoffs is a projection, so texts are never shuffled.

Defined results: null text has no words (base rules reject it); null, unknown or no lang is the stratum 'other'; null
measures don't exist; repeated rows are judged alike; labels without a document, with a null or repeated once more
(the largest quality counts) are harmless; further columns pass through. Empty labels certify nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WHITE = r" \t\n\x0B\f\r"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
STRATA = ("en", "fr", "de", "es")
RISK, DELTA = 0.02, 0.05
#: Rule -> cutoffs from mild to strict. A rule's measure is a share or a rate per word.
RULES = {
    "symbol_rate": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1),
    "upper_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "mark_rate": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1),
    "dup_line_share": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3),
    "same_word_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5),
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the array."""

    def counted(w: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(w) - WINDOW)

        def exact() -> Column:
            keyed = F.sort_array(F.transform(numbers, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("k"), i.alias("i"))))

            def twice(s: Column) -> Column:
                same = lambda i, j: F.get(s, i)["k"] == F.get(s, j)["k"]
                found = F.filter(numbers, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
                places = F.sort_array(F.transform(found, lambda i: F.get(s, i)["i"]))
                start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
                return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

            return let(keyed, twice)

        hashes = F.transform(numbers, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        # Windows that repeat have hashes that repeat: the others need no sort.
        repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) <= WINDOW, 0).when(repeats, exact()).otherwise(0)

    return let(words, counted)


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) and the whole row as `own`, whose names then can't clash; without a column lang it is null."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "text", lang.alias("lang"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))


def measure(docs: DataFrame) -> DataFrame:
    """prepared() rows with a struct column q of counts and measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    # The row number keeps Catalyst from pushing filters on q below this projection, which would repeat its work.
    first = docs.withColumns({"_w": let(words, counts), "_l": let(lines, line_counts), "_row": F.monotonically_increasing_id()})
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    first = first.withColumn("_s", F.struct(count(SYMBOLS).alias("n_symbols"), count(r"\p{Lu}").alias("n_upper"), count("[!?]").alias("n_marks")))
    n = F.greatest(F.col("_w.n_words"), F.lit(1)).cast("double")
    failed = (F.col("_row") >= 0) & ((F.col("_w.n_words") < LEAST_WORDS) | (100 * F.col("_w.n_repeat_words") > MOST_REPEATED * F.col("_w.n_words")))
    q = F.struct(
        *(F.col(f"_w.{c}").alias(c) for c in ("n_words", "word_chars")),
        F.col("_s.n_symbols").alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other").alias("stratum"),
        (F.col("_s.n_symbols") / n).alias("symbol_rate"),
        (F.col("_s.n_upper") / F.greatest(F.col("_w.word_chars"), F.lit(1))).alias("upper_share"),
        (F.col("_s.n_marks") / n).alias("mark_rate"),
        (F.col("_l.n_dup_lines") / F.greatest(F.col("_l.n_lines"), F.lit(1))).alias("dup_line_share"),
        (1 - F.col("_w.n_distinct") / n).alias("same_word_share"),
    )
    return first.withColumn("q", q).drop("_w", "_l", "_s", "_row")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly but for rounding, where k < n p (else 1): the terms fall from k downwards."""
    kk, nn = k.cast("double"), n.cast("double")
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.when(i <= k, F.log((nn - i + 1) / i)).otherwise(0.0))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))

    def add(a: Column, j: Column) -> Column:
        i = kk - j  # the ratio of the term at i - 1 to that at i
        term = a["term"] * F.greatest(i, F.lit(0.0)) / (nn - i + 1) * odds
        return F.struct((a["total"] + term).alias("total"), term.alias("term"))

    total = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, add, lambda a: a["total"])
    exact = F.exp(logs + kk * F.log(F.lit(p)) + (nn - kk) * F.log(F.lit(1 - p))) * total
    return F.when(kk >= nn * p, 1.0).otherwise(F.least(exact, F.lit(1.0)))


def certify(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest certified cutoff of each rule, where there is one."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~F.col("q.base_failed")).select("doc_id", "q").join(good, "doc_id", "left_semi")
    cells = [(r, c) for r, grid in RULES.items() for c in grid]
    sums = held.groupBy("q.stratum").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col(f"q.{r}") >= c).cast("long")).alias(f"c{i}") for i, (r, c) in enumerate(cells)))
    tests = sums.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"c{i}").alias("k")) for i, (r, c) in enumerate(cells)))).alias("t")).select("stratum", "n", "t.*")
    level = delta / (len(RULES) * (len(STRATA) + 1))
    tests = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)))
    milder = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    passed = tests.withColumn("worst", F.max("p").over(milder)).where(F.col("worst") <= level)
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max("n").alias("n_good"), F.max("k").alias("n_rejected"))


def verdict(cutoffs: DataFrame) -> Column:
    """Whether the rules keep a measured row. Reads the cutoffs: at most a row per stratum and rule."""
    rejected = F.lit(False)
    for r in cutoffs.collect():
        rejected = rejected | ((F.col("q.stratum") == r.stratum) & (F.col(f"q.{r.rule}") >= r.cutoff))
    return ~F.col("q.base_failed") & ~rejected


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of each row; texts are measured once and the measures kept in the shared folder."""
    from lakeloom.llm.common import staged

    measured = staged(measure(prepared(docs)).select("doc_id", "q"), "quality")
    kept = verdict(certify(measured, labels))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "stratum", *RULES)
    return measured.select("doc_id", *(f"q.{c}" for c in shown[:6]), kept.alias("kept"), *(f"q.{c}" for c in shown[6:]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that base rules and certified cutoffs keep, with the columns of docs.

    The cutoffs are certified on the labelled rows of docs alone; measuring those first spares a second pass.
    """
    rows = prepared(docs)
    labelled = rows.drop("own").join(labels.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    kept = verdict(certify(measure(labelled), labels))
    return measure(rows).where(kept).select("own.*")
