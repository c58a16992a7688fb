"""The closure that an approved plan must have, as tables of violations (rule, entity, detail): empty means valid.

Tables: documents (document_id, source_id, logical_path), blocks (block_id, document_id, content_hash, text), metadata
(metadata_id, document_id, key, value_index), clusters (cluster_id, title, canonical_path, document_ids), dispositions
(cluster_id, target, kind, rationale) with kind integrated, preserved or omitted, sections (cluster_id, section_id,
heading), evidence (cluster_id, section_id, document_id, block_id, content_hash), findings (cluster_id, finding_id,
severity), waivers (cluster_id, finding_id), omissions (cluster_id, target), approvals (cluster_id, revision_hash),
revisions (cluster_id, revision, revision_hash), related (cluster_id, other), claims (cluster_id, contradiction_id,
claim_id, n_evidence).

Every rule is an aggregate or an equi-join; nulls in a key are violations of `null key` where a key is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions import names
from lakeloom.operators.notes import path_conflicts

SEVERITIES, KINDS = ("minor", "major", "critical"), ("integrated", "preserved", "omitted")


def rows(df: DataFrame, rule: str, entity: Column | str, detail: Column | str | None = None) -> DataFrame:
    said = F.lit("") if detail is None else F.col(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), (F.col(entity) if isinstance(entity, str) else entity).cast("string").alias("entity"), said.cast("string").alias("detail"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(df: DataFrame, rule: str, *key: str) -> DataFrame:
    """Keys that occur more than once, and null keys."""
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    entity = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key))
    none = reduce(Column.__or__, (F.col(k).isNull() for k in key))
    return rows(groups.where((F.col("n") > 1) | none), rule, entity, F.when(none, "null key").otherwise(F.concat(F.col("n").cast("string"), F.lit(" rows"))))


def unknown(df: DataFrame, known: DataFrame, rule: str, *key: str) -> DataFrame:
    """Keys of df that known lacks."""
    entity = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key))
    return rows(df.select(*key).distinct().join(known.select(*key), list(key), "left_anti"), rule, entity)


def differ(left: DataFrame, right: DataFrame, rule: str, *key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(*key).distinct().withColumn("l", F.lit(True)), right.select(*key).distinct().withColumn("r", F.lit(True))
    entity = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key))
    return rows(a.join(b, list(key), "full_outer").where("l IS NULL OR r IS NULL"), rule, entity, F.when(F.col("l").isNull(), "unexpected").otherwise("missing"))


def unsorted(df: DataFrame, rule: str, group: str, order: str, key: str) -> DataFrame:
    """Keys that aren't greater than the one before them, in a group's order; compared as bytes."""
    before = F.lag(key).over(W.partitionBy(group).orderBy(order))
    return rows(df.select(key, before.alias("before")).where(F.encode("before", "UTF-8") >= F.encode(F.col(key), "UTF-8")), rule, key, "before")


def corpus(documents: DataFrame, blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Non-empty, unique ids and places, members of known documents, hashes of their texts, portable legacy paths."""
    empty = documents.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return union(
        rows(empty, "empty corpus", F.lit("corpus")),
        repeated(documents, "repeated document", "document_id"),
        repeated(documents, "repeated path", "source_id", "logical_path"),
        repeated(blocks, "repeated block", "block_id"),
        repeated(metadata, "repeated metadata", "metadata_id"),
        repeated(metadata, "repeated metadata value", "document_id", "key", "value_index"),
        unknown(blocks, documents, "block of no document", "document_id"),
        unknown(metadata, documents, "metadata of no document", "document_id"),
        rows(blocks.where(~F.sha2(F.coalesce("text", F.lit("")), 256).eqNullSafe(F.col("content_hash"))), "block hash", "block_id"),
        rows(path_conflicts(documents.select(F.col("logical_path").alias("path"))), "legacy path", "key", F.col("rule")),
    )


def members(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.explode("document_ids").alias("document_id"))


def taxonomy(clusters: DataFrame, documents: DataFrame) -> DataFrame:
    """Unique clusters with portable .md paths, none empty; each known document in exactly one."""
    problem = names.column(names.output_path_problem)("canonical_path")
    own = members(clusters)
    return union(
        repeated(clusters, "repeated cluster", "cluster_id"),
        rows(clusters.where(F.coalesce(F.size("document_ids"), F.lit(0)) < 1), "empty cluster", "cluster_id"),
        rows(clusters.select("cluster_id", F.when(~F.col("canonical_path").endswith(".md"), "not .md").otherwise(problem).alias("why")).where("why IS NOT NULL"), "cluster path", "cluster_id", "why"),
        rows(path_conflicts(clusters.select(F.col("canonical_path").alias("path"))), "cluster paths", "key", F.col("rule")),
        repeated(own, "document in several clusters", "document_id"),
        differ(documents, own, "document coverage", "document_id"),
    )


def evidence(cited: DataFrame, clusters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cited once in a section, from the cluster's documents, with the block's hash."""
    own = members(clusters).join(blocks.select("document_id", "block_id", "content_hash"), "document_id")
    return union(repeated(cited, "repeated evidence", "cluster_id", "section_id", "block_id"), unknown(cited, own, "evidence", "cluster_id", "document_id", "block_id", "content_hash"))


def revision(clusters: DataFrame, blocks: DataFrame, metadata: DataFrame, dispositions: DataFrame, sections: DataFrame, cited: DataFrame, omissions: DataFrame, related: DataFrame, claims: DataFrame) -> DataFrame:
    """One disposition per block and metadata row; omissions with reason and approval; sections with evidence; what is
    integrated is cited; links to known clusters; contradictions of two claims, each with evidence."""
    own = members(clusters)
    wanted = own.join(blocks.select("document_id", F.col("block_id").alias("target")), "document_id").union(own.join(metadata.select("document_id", F.col("metadata_id").alias("target")), "document_id"))
    omitted = dispositions.where("kind = 'omitted'")
    integrated = dispositions.where("kind = 'integrated'").join(blocks.select(F.col("block_id").alias("target")), "target", "left_semi")
    sizes = claims.groupBy("cluster_id", "contradiction_id").agg(F.countDistinct("claim_id").alias("n"), F.min(F.coalesce("n_evidence", F.lit(0))).alias("least"))
    other = related.select(F.col("other").alias("cluster_id"))
    return union(
        differ(wanted, dispositions, "disposition", "cluster_id", "target"),
        repeated(dispositions, "repeated disposition", "cluster_id", "target"),
        rows(dispositions.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))), "disposition kind", "target", "kind"),
        rows(omitted.where(F.trim(F.coalesce("rationale", F.lit(""))) == ""), "omission without reason", "target"),
        differ(omitted, omissions, "omission approval", "cluster_id", "target"),
        repeated(sections, "repeated section", "cluster_id", "section_id"),
        unknown(sections, cited, "section without evidence", "cluster_id", "section_id"),
        unknown(integrated, cited.select("cluster_id", F.col("block_id").alias("target")), "integrated but not cited", "cluster_id", "target"),
        unknown(other, clusters, "related cluster", "cluster_id"),
        rows(sizes.where("n < 2"), "contradiction of one claim", "contradiction_id"),
        rows(sizes.where("least < 1"), "claim without evidence", "contradiction_id"),
    )


def critic(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Unique findings, none major or critical, and waivers for exactly the minor ones."""
    return union(
        repeated(findings, "repeated finding", "cluster_id", "finding_id"),
        rows(findings.where(~F.coalesce(F.col("severity") == "minor", F.lit(False))), "blocking finding", "finding_id", F.coalesce("severity", F.lit("null"))),
        differ(findings.where("severity = 'minor'"), waivers, "waiver", "cluster_id", "finding_id"),
        repeated(waivers, "repeated waiver", "cluster_id", "finding_id"),
    )


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """Each cluster's latest revision; of equal numbers the later sequence."""
    return revisions.groupBy("cluster_id").agg(F.max_by(F.struct("revision", "revision_hash"), F.struct("revision", "sequence")).alias("r")).select("cluster_id", "r.*")


def approvals(clusters: DataFrame, revisions: DataFrame, given: DataFrame) -> DataFrame:
    """Each cluster's latest revision is approved as it is, once; nothing else is."""
    latest = latest_revisions(revisions)
    return union(
        unknown(clusters, revisions, "cluster without revision", "cluster_id"),
        unknown(revisions, clusters, "revision of no cluster", "cluster_id"),
        repeated(given, "repeated approval", "cluster_id"),
        differ(latest, given, "approval", "cluster_id", "revision_hash"),
    )


def recordings(recorded: DataFrame, organizer: str) -> DataFrame:
    """Unique hashes (column recording) that include the organizer's."""
    has = recorded.agg(F.count_if(F.col("recording") == organizer).alias("n")).where("n = 0")
    return union(repeated(recorded, "repeated recording", "recording"), rows(has, "no organizer recording", F.lit(organizer)))


def ambiguity(conflicts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Conflicts (link_id) for exactly the ambiguous links."""
    return differ(resolved.where("resolution = 'ambiguous'"), conflicts, "ambiguity", "link_id")


def operations(planned: DataFrame, outputs: DataFrame) -> DataFrame:
    """Planned operations (id, path) reach every output (id, path) once, at portable destinations."""
    return union(differ(outputs, planned, "operation", "id", "path"), repeated(planned, "repeated destination", "path"), rows(path_conflicts(planned), "destination", "key", F.col("rule")))


def spans(parts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Parts (key, document_id, byte_start, byte_end) that end before they begin or after their file (document_id, byte_len)."""
    joined = parts.join(files.select("document_id", "byte_len"), "document_id", "left")
    bad = F.col("byte_len").isNull() | (F.col("byte_start") < 0) | (F.col("byte_end") < F.col("byte_start")) | (F.col("byte_end") > F.col("byte_len"))
    return rows(joined.where(bad), "span", key, F.concat_ws("-", F.col("byte_start").cast("string"), F.col("byte_end").cast("string")))


def require(violations: DataFrame, most: int = 20) -> None:
    """Raises with the first violations, if there are any."""
    if found := violations.limit(most).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.entity} {r.detail}".rstrip() for r in found))
