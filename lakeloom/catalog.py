"""All queries of the library's own operators, and DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions.identity import domain_hash
from lakeloom.operators import closure, dedup, journal, links, semantic

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "exact_duplicate_groups"


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            names = f.__code__.co_varnames[: f.__code__.co_argcount]
            return f(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _hash(domain: str, value: str) -> str:
    return f"sha256(encode('{domain}') || '\\x00'::BLOB || encode({value}))"


BODY = _hash(dedup.BODY, "text")


@query(f"SELECT body_hash, canonical, n_members, doc_id FROM (SELECT doc_id, {BODY} AS body_hash, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS n_members FROM documents) WHERE n_members > 1")
def exact_duplicate_groups(documents):
    return dedup.exact_groups(documents)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents")
def representative_map(documents):
    return dedup.representative_map(documents)


@query(f"SELECT {BODY} AS body_hash, count(*) AS n_members, count(DISTINCT lang || '|' || source) AS n_variants FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lang || '|' || source) > 1")
def metadata_conflicts(documents):
    return dedup.metadata_conflicts(documents)


@query(f"SELECT doc_id, {_hash('lakeloom:content', 'text')} AS content_hash, {_hash('lakeloom:document', 'doc_id::VARCHAR')} AS document_id FROM documents")
def content_hashes(documents):
    return documents.select("doc_id", domain_hash("lakeloom:content", F.col("text")).alias("content_hash"), domain_hash("lakeloom:document", F.col("doc_id")).alias("document_id"))


@query("""SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS normalized_hash FROM documents""")
def normalized_text(documents):
    return documents.select("doc_id", F.sha2(T.normalize_newlines(F.col("text")), 256).alias("normalized_hash"))


@query(r"""SELECT doc_id, ordinal, octet_length(encode(line))::BIGINT AS n_bytes, CASE WHEN regexp_matches(line, '^\s*> \[!') THEN 'callout' WHEN regexp_matches(line, '^\s*>') THEN 'quote' WHEN regexp_matches(line, '^\s*(\$\$|\\\[)') THEN 'math' WHEN regexp_matches(line, '^\s*([-*+] |[0-9]+[.)] )') THEN 'list' ELSE 'paragraph' END AS kind
FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS ordinal FROM documents) WHERE line <> ''""")
def line_blocks(documents):
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).where("line <> ''")
    return lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.octet_length("line").cast("long").alias("n_bytes"), T.block_kind(F.col("line")).alias("kind"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, role, octet_length(encode(text))::BIGINT AS n_bytes FROM conversations")
def conversation_blocks(conversations):
    from pyspark.sql import Window as W

    return conversations.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("ordinal"), "role", F.octet_length("text").cast("long").alias("n_bytes"))


LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) - 1 AS ordinal FROM pages)"""


@query(f"WITH {LINKS} SELECT page_id, ordinal, target, regexp_matches(lower(target), '^(https?://|mailto:|data:|obsidian:|//)') AS external FROM links")
def page_links(pages):
    return links.page_links(pages).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(rf"""WITH {LINKS},
n AS (SELECT *, lower(replace(regexp_replace(target, '^(\./)+', ''), '\', '/')) AS k1 FROM links),
l AS (SELECT *, regexp_replace(k1, '^[a-z]+://[^/]*', '') AS k2 FROM n),
p0 AS (SELECT page_id AS to_page, lower(replace(regexp_replace(url, '^(\./)+', ''), '\', '/')) AS k1 FROM pages),
p AS (SELECT *, regexp_replace(k1, '^[a-z]+://[^/]*', '') AS k2 FROM p0),
a AS (SELECT k1, count(*) AS n1, min(to_page) AS to1 FROM p GROUP BY 1), b AS (SELECT k2, count(*) AS n2, min(to_page) AS to2 FROM p GROUP BY 1)
SELECT page_id, ordinal, CASE WHEN coalesce(n1, n2, 0) = 0 THEN 'unresolved' WHEN coalesce(n1, n2) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN coalesce(n1, n2) = 1 THEN coalesce(to1, to2) END AS to_page FROM l LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""")
def resolved_links(pages):
    return links.resolve(pages).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT lower(trim(p_name)) AS lookup_key, count(DISTINCT p_partkey) AS n_members, min(p_partkey) AS least FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def title_ambiguity(part):
    return links.ambiguous_keys(part, "p_name", "p_partkey")


@query("SELECT l_orderkey, section, count(*) AS n_blocks FROM (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING) AS section FROM lineitem) GROUP BY 1, 2")
def section_blocks(lineitem):
    return closure.section_blocks(lineitem, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R").groupBy("l_orderkey", "section").agg(F.count(F.lit(1)).alias("n_blocks"))


@query("SELECT CASE WHEN a.n IS NULL THEN 'unknown' WHEN b.n IS NULL THEN 'uncovered' WHEN b.n = 1 THEN 'once' ELSE 'repeated' END AS state, count(*) AS n FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) b USING (doc_id) GROUP BY 1")
def coverage_exactly_once(documents, labels):
    return closure.coverage(documents, labels)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered_documents(documents, labels):
    return closure.uncovered(documents, labels)


@query("SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def orphan_evidence(lineitem, orders):
    kept = orders.where("o_orderstatus = 'F'")
    return lineitem.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


@query("(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM labels WHERE quality = 0 EXCEPT ALL SELECT doc_id FROM labels WHERE toxic = 1)) UNION ALL (SELECT doc_id, 'right' AS side FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT ALL SELECT doc_id FROM labels WHERE quality = 0))")
def disposition_closure(labels):
    return closure.set_difference(labels.where("quality = 0").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


PHONES = "list_filter(regexp_extract_all(text, '[0-9+][0-9+() -]*'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 10)"
EMAILS = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: regexp_replace(t, '^[,.;:()<>]+|[,.;:()<>]+$', '', 'g')), lambda t: regexp_matches(t, '^[^@]+@.*\..*[^.]$'))"
MARKERS = r"""regexp_extract_all(text, '(?:sk-|ghp_|AKIA|postgres://|mongodb://)[^\s"''`<>]+|-----BEGIN (?:OPENSSH )?PRIVATE KEY-----')"""


@query(f"SELECT * FROM (SELECT doc_id, len({EMAILS})::BIGINT AS n_emails, len({PHONES})::BIGINT AS n_phones, len({MARKERS})::BIGINT AS n_markers FROM documents) WHERE n_emails + n_phones + n_markers > 0")
def sensitive_findings(documents):
    found = documents.select("doc_id", *(F.size(f(F.col("text"))).cast("long").alias(f"n_{k}") for k, f in (("emails", T.emails), ("phones", T.phones), ("markers", T.markers))))
    return found.where("n_emails + n_phones + n_markers > 0")


@query(f"SELECT source, sum(len({EMAILS}))::BIGINT AS n_emails, sum(len({PHONES}))::BIGINT AS n_phones, count(*) AS n_documents FROM documents GROUP BY 1")
def sensitive_summary(documents):
    found = documents.select("source", F.size(T.emails(F.col("text"))).alias("e"), F.size(T.phones(F.col("text"))).alias("p"))
    return found.groupBy("source").agg(F.sum("e").alias("n_emails"), F.sum("p").alias("n_phones"), F.count(F.lit(1)).alias("n_documents"))


@query(f"SELECT doc_id, {PHONES}[1] IS NULL AND {EMAILS}[1] IS NULL AS remote_allowed FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def disclosure_gate(documents, labels):
    disclosed = documents.join(labels.where("quality = 1"), "doc_id", "left_semi")
    return disclosed.select("doc_id", ((F.size(T.phones(F.col("text"))) == 0) & (F.size(T.emails(F.col("text"))) == 0)).alias("remote_allowed"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS sequence FROM events GROUP BY 1")
def latest_status(events):
    return journal.latest_status(events)


@query("SELECT status, count(*) AS n_tasks FROM (SELECT arg_max(event_type, event_id) AS status FROM events GROUP BY user_id) GROUP BY 1")
def run_status_counts(events):
    return journal.status_counts(events)


@query("SELECT coalesce(max(event_id), 0) + 1 AS next_sequence FROM events")
def next_sequence(events):
    return journal.next_sequence(events)


@query("SELECT user_id, max(event_id) AS sequence, count(*) AS n_events FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'click'")
def stage_tasks(events):
    return journal.stage_tasks(events, "click")


@query("SELECT user_id, count(CASE WHEN step <= 0 THEN 1 END) AS n_unsorted, max(step) AS largest_step FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) GROUP BY 1")
def sequence_gaps(events):
    return journal.sequence_gaps(events)


@query("SELECT 'doc/' || doc_id || '.md' AS path, octet_length(encode(text))::BIGINT AS byte_len, sha256(text) || '  doc/' || doc_id || '.md' AS checksum_line FROM documents")
def manifest_inventory(documents):
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.select(path.alias("path"), F.octet_length("text").cast("long").alias("byte_len"), F.concat(F.sha2("text", 256), F.lit("  "), path).alias("checksum_line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE doc_id % 3 = 0 OR lang = 'fr'")
def artifact_diff(documents):
    before = documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    after = documents.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return closure.diff(before, after, "doc_id", "hash")


@query("SELECT count(*) AS n_documents, sum(octet_length(encode(text)))::BIGINT AS n_bytes, max(octet_length(encode(text)))::BIGINT * 2 + 16777216 AS peak_bytes, ceil(sum(octet_length(encode(text))) / 6.0)::BIGINT AS least_tokens, 2 + 2 * count(*) AS most_requests FROM documents")
def resource_estimate(documents):
    size = F.octet_length("text").cast("long")
    return documents.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(size).alias("n_bytes"), (F.max(size) * 2 + 16777216).alias("peak_bytes"), F.ceil(F.sum(size) / F.lit(6.0)).cast("long").alias("least_tokens"), (2 + 2 * F.count(F.lit(1))).alias("most_requests"))


@query("SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_norms(embeddings):
    return semantic.norms(embeddings)


@query("""SELECT vec_id, neighbour, score FROM (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])::FLOAT::DOUBLE, 5) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3) WHERE r <= 8""")
def semantic_topk(embeddings):
    return semantic.top_k(embeddings, 0.3, 8)


@query()
def lsh_buckets(documents):
    return dedup.lsh_buckets(dedup.minhash_signatures(documents, "doc_id"), "doc_id")


@query()
def near_duplicates(documents):
    return dedup.near_duplicates(documents, "doc_id")


@query(r"""SELECT page_id, CASE e WHEN 'md' THEN 'markdown' WHEN 'canvas' THEN 'canvas' WHEN 'base' THEN 'base' ELSE 'asset' END AS kind, CASE e WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'svg' THEN 'image/svg+xml' WHEN 'pdf' THEN 'application/pdf' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS media, regexp_matches(url, '(^|/)(\.git|\.obsidian|\.DS_Store|\.env|id_rsa|credentials\.json)(/|$)|\.(exe|dll|so|pem|key|sh)$') AS excluded
FROM (SELECT page_id, url, lower(regexp_extract(url, '[^/.]\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)""")
def file_kinds(pages):
    url = F.col("url")
    return pages.select("page_id", T.file_kind(url).alias("kind"), T.media_type(url).alias("media"), T.is_excluded(url).alias("excluded"))


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'source': source, 'hash': sha256(text), 'quality': quality})::VARCHAR AS record FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_records(documents, labels):
    both = documents.join(labels, "doc_id", "left")
    record = F.to_json(F.struct("doc_id", "source", F.sha2("text", 256).alias("hash"), "quality"), {"ignoreNullFields": "false"})
    return both.select("doc_id", record.alias("record"))
