"""Queries over notes, plans and journals made from the driver's tables, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.catalog import query
from lakeloom.functions import identity, names
from lakeloom.operators import approval, journal, notes, semantic, sensitive
from lakeloom.plans import artifact, markdown

HEAD = "---\ntitle: Note %s\naliases: [a%s]\n---\n"
TITLE, CODE, LINKS = "# Note %s\n", "~~~~~~~~\n%s\n~~~~~~~~\n", "## Links\n"
LIST = "- [[%s|next]] `[[none]]` ![[a%s#links]] [up](../9/x%%20y.md#Top) [w](https://example.org/%s)\n"


def filled(template: str, *values):
    return F.format_string(template, *values)


def note_files(documents: DataFrame) -> DataFrame:
    """A note of each document: frontmatter, a title, the whole text in a fence, and a list of links."""
    i = F.col("doc_id")
    parts = (filled(HEAD, i, i), filled(TITLE, i), F.lit("\n"), F.concat(F.lit("~~~~~~~~\n"), F.coalesce("text", F.lit("")), F.lit("\n~~~~~~~~\n")), F.lit("\n"), F.lit(LINKS), F.lit("\n"), filled(LIST, i + 1, i + 2, i))
    return documents.select("doc_id", F.lit("v").alias("source_id"), F.concat(F.lit("n/"), (i % 10).cast("string"), F.lit("/"), i.cast("string"), F.lit(".md")).alias("logical_path"), F.encode(F.concat(*parts), "UTF-8").alias("content"))


PATH = "'n/' || (doc_id % 10) || '/' || doc_id || '.md'"
NOTES = f"""notes AS (SELECT doc_id, {PATH} AS logical_path, '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'aliases: [a' || doc_id || ']' || chr(10) || '---' || chr(10) AS head,
'# Note ' || doc_id || chr(10) AS title, '~~~~~~~~' || chr(10) || text || chr(10) || '~~~~~~~~' || chr(10) AS code, '## Links' || chr(10) AS links,
'- [[' || (doc_id + 1) || '|next]] `[[none]]` ![[a' || (doc_id + 2) || '#links]] [up](../9/x%20y.md#Top) [w](https://example.org/' || doc_id || ')' || chr(10) AS list FROM documents)"""
SIZE = "octet_length(encode({}))"


@query(f"""WITH {NOTES}, b AS (SELECT logical_path, 0 AS ordinal, 'heading' AS kind, head AS before, title AS own FROM notes UNION ALL SELECT logical_path, 1, 'code', head || title || chr(10), code FROM notes
UNION ALL SELECT logical_path, 2, 'heading', head || title || chr(10) || code || chr(10), links FROM notes UNION ALL SELECT logical_path, 3, 'list', head || title || chr(10) || code || chr(10) || links || chr(10), list FROM notes)
SELECT logical_path, ordinal::BIGINT AS ordinal, kind, {SIZE.format('before')}::BIGINT AS byte_start, ({SIZE.format('before')} + {SIZE.format('own')})::BIGINT AS byte_end FROM b""")
def markdown_blocks(documents):
    return markdown.parts(markdown.parse_notes(note_files(documents)), "blocks").select("logical_path", "ordinal", "kind", "byte_start", "byte_end")


@query(f"""SELECT {PATH} AS logical_path, 'Note ' || doc_id AS heading, 1 AS level, 'Note ' || doc_id AS trail, 4::BIGINT AS n_blocks FROM documents UNION ALL SELECT {PATH}, 'Links', 2, 'Note ' || doc_id || '/Links', 2 FROM documents""")
def markdown_sections(documents):
    rows = markdown.parts(markdown.parse_notes(note_files(documents)), "sections")
    return rows.select("logical_path", "heading", "level", F.array_join("heading_path", "/").alias("trail"), F.size("blocks").cast("long").alias("n_blocks"))


@query(f"""SELECT {PATH} AS logical_path, 0::BIGINT AS ordinal, 'wiki' AS syntax, (doc_id + 1) || '|next' AS raw_target, (doc_id + 1)::VARCHAR AS path, NULL AS heading, 'next' AS display, false AS embed FROM documents
UNION ALL SELECT {PATH}, 1, 'wiki', 'a' || (doc_id + 2) || '#links', 'a' || (doc_id + 2), 'links', NULL, true FROM documents
UNION ALL SELECT {PATH}, 2, 'markdown', '../9/x%20y.md#Top', '../9/x y.md', 'Top', 'up', false FROM documents
UNION ALL SELECT {PATH}, 3, 'markdown', 'https://example.org/' || doc_id, NULL, NULL, 'w', false FROM documents""")
def markdown_links(documents):
    return markdown.parts(markdown.parse_notes(note_files(documents)), "links").select("logical_path", "ordinal", "syntax", "raw_target", "path", "heading", "display", "embed")


@query("SELECT 'Note ' || doc_id AS title, 'a' || doc_id AS alias, '{\"aliases\":[\"a' || doc_id || '\"],\"title\":\"Note ' || doc_id || '\"}' AS frontmatter, " + f"{PATH} AS logical_path FROM documents")
def frontmatter_fields(documents):
    return markdown.parse_notes(note_files(documents)).select("title", F.array_join("aliases", ",").alias("alias"), "frontmatter", "logical_path")


@query(f"SELECT {PATH} AS logical_path, 'title' AS key, 0 AS value_index, 'Note ' || doc_id AS value FROM documents UNION ALL SELECT {PATH}, 'aliases', 0, 'a' || doc_id FROM documents")
def metadata_values(documents):
    parsed = markdown.parse_notes(note_files(documents))
    return markdown.metadata_rows(parsed).join(parsed.select("document_id", "logical_path"), "document_id").select("logical_path", "key", "value_index", "value")


@query(f"SELECT key, {PATH} AS logical_path FROM (SELECT doc_id, unnest(['note ' || doc_id, 'a' || doc_id, doc_id::VARCHAR]) AS key FROM documents)")
def note_keys(documents):
    parsed = markdown.parse_notes(note_files(documents))
    return markdown.lookup_keys(parsed).join(parsed.select("document_id", "logical_path"), "document_id").select("key", "logical_path")


@query(f"""SELECT {PATH} AS logical_path, ordinal::BIGINT AS ordinal, CASE WHEN ordinal = 3 THEN 'external' WHEN ordinal < 2 AND doc_id + ordinal + 1 IN (SELECT doc_id FROM documents) THEN 'resolved' ELSE 'unresolved' END AS resolution,
CASE WHEN ordinal < 2 AND doc_id + ordinal + 1 IN (SELECT doc_id FROM documents) THEN 'n/' || ((doc_id + ordinal + 1) % 10) || '/' || (doc_id + ordinal + 1) || '.md' END AS target_path FROM documents, (SELECT unnest([0, 1, 2, 3]) AS ordinal)""")
def note_links(documents):
    parsed = markdown.parse_notes(note_files(documents))
    found = notes.resolve_links(parsed).join(parsed.select("document_id", "logical_path"), "document_id")
    there = parsed.select(F.col("document_id").alias("target"), F.col("logical_path").alias("target_path"))
    return found.join(there, "target", "left").select("logical_path", "ordinal", "resolution", "target_path")


@query("SELECT doc_id, sha256(replace(lower(nfc_normalize(text)), 'ß', 'ss')) AS key_hash FROM documents")
def folded_texts(documents):
    return documents.select("doc_id", F.sha2(names.column(names.casefold_nfc)("text"), 256).alias("key_hash"))


SUFFIX = "'~' || " + " || ".join(f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', (((('0x' || substr(h, 1, 10))::BIGINT >> {35 - 5 * k}) & 31) + 1)::INT, 1)" for k in range(8))


@query(f"SELECT p_partkey AS id, CASE WHEN place = 1 THEN p_type || '.md' ELSE p_type || {SUFFIX} || '.md' END AS path FROM (SELECT p_partkey, p_type, sha256(p_partkey::VARCHAR) AS h, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_type, p_partkey) AS place FROM part)")
def path_allocation(part):
    return notes.allocate(part.select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(".md")).alias("logical_path"))).select("id", "path")


EMAIL = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: regexp_replace(t, '^[,.;:()<>]+|[,.;:()<>]+$', '', 'g')), lambda t: regexp_matches(t, '^[^@]+@.*\..*[^.]$'))"
PHONE = "list_filter(regexp_extract_all(text, '[0-9+][0-9+() -]*'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 10)"


@query(f"""SELECT doc_id, category, count(*) AS n, sum({SIZE.format('m')})::BIGINT AS n_bytes, sha256(string_agg(sha256('lakeloom:sensitive-span'::BLOB || '\\x00'::BLOB || encode(m)), ',' ORDER BY sha256('lakeloom:sensitive-span'::BLOB || '\\x00'::BLOB || encode(m)))) AS hashes
FROM (SELECT doc_id, 'email' AS category, unnest({EMAIL}) AS m FROM documents UNION ALL SELECT doc_id, 'phone', unnest({PHONE}) FROM documents) GROUP BY 1, 2""")
def sensitive_spans(documents):
    found = sensitive.find(documents, "doc_id").where("category IN ('email', 'phone')")
    return found.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("n_bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("span_hash")), ","), 256).alias("hashes"))


@query(f"SELECT doc_id, category FROM (SELECT doc_id, 'email' AS category, unnest({EMAIL}) AS m FROM documents UNION ALL SELECT doc_id, 'phone', unnest({PHONE}) FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def effective_findings(documents, labels):
    found = sensitive.find(documents, "doc_id").where("category IN ('email', 'phone')")
    return sensitive.effective(found, labels.where("toxic = 0").select("doc_id")).select("doc_id", "category")


def plan_clusters(labels: DataFrame) -> DataFrame:
    """Clusters of up to 100 consecutive ids."""
    key = F.floor(F.col("doc_id") / 100).cast("string")
    return labels.select("doc_id").distinct().groupBy(key.alias("cluster_id")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("document_ids")).withColumns({"title": F.concat(F.lit("Cluster "), "cluster_id"), "canonical_path": F.concat(F.lit("c/"), "cluster_id", F.lit(".md"))})


@query("SELECT 'document coverage' AS rule, doc_id::VARCHAR AS entity, 'missing' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'document coverage', doc_id::VARCHAR, 'unexpected' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def taxonomy_violations(documents, labels):
    return approval.taxonomy(plan_clusters(labels), documents.select(F.col("doc_id").cast("string").alias("document_id")))


@query("SELECT 'evidence' AS rule, (doc_id // 100) || ':' || doc_id || ':b' || doc_id || ':' || sha256(text || '!') AS entity, '' AS detail FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id IN (SELECT doc_id FROM labels)")
def evidence_violations(documents, labels):
    i = F.col("doc_id").cast("string")
    blocks = documents.select(i.alias("document_id"), F.concat(F.lit("b"), i).alias("block_id"), F.sha2("text", 256).alias("content_hash"))
    forged = documents.join(labels.select("doc_id", "quality").distinct(), "doc_id")
    cited = forged.select(F.floor(F.col("doc_id") / 100).cast("string").alias("cluster_id"), F.concat(F.lit("s"), i).alias("section_id"), i.alias("document_id"), F.concat(F.lit("b"), i).alias("block_id"), F.sha2(F.concat("text", F.when(F.col("quality") == 0, "!").otherwise("")), 256).alias("content_hash"))
    return approval.evidence(cited, plan_clusters(labels), blocks)


@query("SELECT 'blocking finding' AS rule, doc_id::VARCHAR AS entity, 'major' AS detail FROM labels WHERE toxic = 1 UNION ALL SELECT 'waiver', '0:' || doc_id, 'missing' FROM labels WHERE toxic = 0 AND quality = 0 UNION ALL SELECT 'waiver', '0:' || doc_id, 'unexpected' FROM labels WHERE toxic = 1 AND quality = 1")
def critic_violations(labels):
    findings = labels.select(F.lit(0).alias("cluster_id"), F.col("doc_id").alias("finding_id"), F.when(F.col("toxic") == 1, "major").otherwise("minor").alias("severity"))
    return approval.critic(findings, labels.where("quality = 1").select(F.lit(0).alias("cluster_id"), F.col("doc_id").alias("finding_id")))


REVISIONS = "(SELECT user_id, arg_max(event_type, struct_pack(a := event_id % 7, b := event_id)) AS revision_hash FROM events GROUP BY 1)"


@query(f"SELECT 'approval' AS rule, user_id || ':' || revision_hash AS entity, 'missing' AS detail FROM {REVISIONS} WHERE revision_hash <> 'click' UNION ALL SELECT 'approval', user_id || ':click', 'unexpected' FROM {REVISIONS} WHERE revision_hash <> 'click'")
def approval_violations(events):
    revisions = events.select(F.col("user_id").alias("cluster_id"), (F.col("event_id") % 7).alias("revision"), F.col("event_id").alias("sequence"), F.col("event_type").alias("revision_hash"))
    clusters = events.select(F.col("user_id").alias("cluster_id")).distinct()
    return approval.approvals(clusters, revisions, clusters.withColumn("revision_hash", F.lit("click")))


@query("SELECT arg_max(event_id, event_id) AS plan_id, max(event_id) AS sequence FROM events WHERE event_type = 'purchase' AND user_id = (SELECT arg_max(user_id, event_id) FROM events) HAVING count(*) > 0")
def current_plan(events):
    runs = events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"))
    plans = events.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("plan_id"), F.col("event_id").alias("sequence"))
    return journal.latest_plan(runs, plans).select("plan_id", "sequence")


@query("SELECT user_id AS run_id, event_type AS kind, max(event_id) AS sequence, arg_max(ts, event_id) AS ts FROM events GROUP BY 1, 2")
def latest_approvals(events):
    rows = events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("sequence"), "ts")
    return journal.latest(rows, "run_id", "kind").select("run_id", "kind", "sequence", "ts")


@query("SELECT arg_max(user_id, event_id) AS run_id, (SELECT count(*) > 0 FROM events WHERE event_type = 'purchase' AND user_id = (SELECT arg_max(user_id, event_id) FROM events)) AS has_work FROM events")
def run_has_work(events):
    runs = events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"))
    return journal.has_work(runs, events.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id")))


@query(f"WITH {NOTES}, m AS (SELECT logical_path AS path, head || title || chr(10) || code || chr(10) || links || chr(10) || list AS content FROM notes) SELECT path, {SIZE.format('content')}::BIGINT AS byte_len, sha256(content) AS raw_sha256, sha256('lakeloom:content'::BLOB || '\\x00'::BLOB || encode(content)) AS content_hash, sha256(content) || '  ' || path AS checksum_line FROM m")
def note_manifest(documents):
    return artifact.manifest(note_files(documents).withColumnRenamed("logical_path", "path"))


@query(f"SELECT 'artifact' AS rule, {PATH} AS entity, CASE WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS detail FROM documents WHERE doc_id % 7 IN (0, 1)")
def artifact_violations(documents):
    planned = note_files(documents).withColumnRenamed("logical_path", "path")
    found = planned.where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 1, F.unhex(F.lit("00"))).otherwise(F.col("content")))
    return artifact.verify(planned, found)


@query(f"SELECT {PATH} AS logical_path, sha256('t'::BLOB || '\\x00'::BLOB || unhex(printf('%02x', length({PATH}))) || encode({PATH}) || '\\x02'::BLOB || encode('ab')) AS id FROM documents")
def path_identities(documents):
    files = note_files(documents)
    return files.select("logical_path", identity.parts_hash_of("t", F.encode("logical_path", "UTF-8"), F.encode(F.lit("ab"), "UTF-8")).alias("id"))


@query("SELECT vec_id, 'length' AS problem FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT vec_id, 'zero' FROM embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) = 0")
def invalid_vectors(embeddings):
    return semantic.invalid(embeddings, 64)
