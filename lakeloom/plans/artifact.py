"""What an approved plan writes: canonical notes and stubs, manifest and provenance, and their verification.

Tables: documents (document_id, logical_path), clusters (cluster_id, title, canonical_path, document_ids), sections
(cluster_id, ordinal, heading, body), metadata (cluster_id, key, value). Rows of outputs are (path, kind, entity,
content); nulls in headings or bodies count as empty, a cluster without sections is a title alone.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import names
from lakeloom.functions.identity import domain_hash
from lakeloom.operators import closure

VIOLATION = ("rule", "entity", "detail")


def quoted(text: Column) -> Column:
    """A string as JSON, which YAML reads alike."""
    return names.column(lambda t: json.dumps(t, ensure_ascii=False))(text)


def canonical_notes(clusters: DataFrame, sections: DataFrame, metadata: DataFrame) -> DataFrame:
    """A note per cluster: a YAML header of its id and metadata, its title and its sections in order."""
    body = F.concat(F.lit("## "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    joined = sections.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", body.alias("text")))), lambda s: s["text"]), "\n").alias("body"))
    line = F.concat("key", F.lit(": "), quoted(F.col("value")))
    header = metadata.where("value IS NOT NULL").groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("header"))
    rows = clusters.select("cluster_id", "title", "canonical_path").join(joined, "cluster_id", "left").join(header, "cluster_id", "left")
    top = F.concat(F.lit("---\ncluster: "), quoted(F.col("cluster_id")), F.lit("\n"), F.coalesce(F.concat("header", F.lit("\n")), F.lit("")), F.lit("---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n"))
    return rows.select(F.col("canonical_path").alias("path"), F.lit("note").alias("kind"), F.col("cluster_id").alias("entity"), F.encode(F.concat(top, F.coalesce(F.concat(F.lit("\n"), "body"), F.lit(""))), "UTF-8").alias("content"))


def stubs(documents: DataFrame, clusters: DataFrame) -> DataFrame:
    """A redirecting note per document, under legacy/ and its old path."""
    member = clusters.select(F.explode("document_ids").alias("document_id"), "title", "canonical_path")
    rows = documents.join(member, "document_id").withColumn("path", F.concat(F.lit("legacy/"), "logical_path"))
    link = names.column(lambda a, b: names.escape_destination(names.relative(a, b)))("path", "canonical_path")
    return rows.select("path", F.lit("stub").alias("kind"), F.col("document_id").alias("entity"), F.encode(F.concat(F.lit("Moved to ["), F.coalesce("title", F.lit("")), F.lit("]("), link, F.lit(").\n")), "UTF-8").alias("content"))


def materialize(documents: DataFrame, clusters: DataFrame, sections: DataFrame, metadata: DataFrame) -> DataFrame:
    return canonical_notes(clusters, sections, metadata).union(stubs(documents, clusters))


def manifest(outputs: DataFrame, namespace: str = "lakeloom") -> DataFrame:
    """(path, byte_len, raw_sha256, content_hash, checksum_line)."""
    sha = F.sha2("content", 256)
    hashed = F.sha2(F.concat(F.encode(F.lit(f"{namespace}:content"), "UTF-8"), F.unhex(F.lit("00")), "content"), 256)
    return outputs.select("path", F.octet_length("content").cast("long").alias("byte_len"), sha.alias("raw_sha256"), hashed.alias("content_hash"), F.concat(sha, F.lit("  "), "path").alias("checksum_line"))


def checksum_hash(inventory: DataFrame) -> str:
    """Hash of the checksum lines in byte order of paths, streamed through the driver."""
    state = hashlib.sha256()
    for r in inventory.orderBy(F.encode("path", "UTF-8")).select("checksum_line").toLocalIterator():
        state.update(f"{r.checksum_line}\n".encode())
    return state.hexdigest()


def provenance(outputs: DataFrame, evidence: DataFrame, namespace: str = "lakeloom") -> DataFrame:
    """(path, record): a JSON line per output with its hash, and for notes the evidence blocks, sorted, each once.

    evidence: (cluster_id, block_id)."""
    blocks = evidence.groupBy(F.col("cluster_id").alias("entity")).agg(F.sort_array(F.collect_set("block_id")).alias("evidence"))
    rows = outputs.join(blocks, "entity", "left").withColumns({"sha256": F.sha2("content", 256), "evidence": F.coalesce("evidence", F.array().cast("array<string>"))})
    record_id = domain_hash(f"{namespace}:provenance", F.col("path"), F.lit("\0"), F.col("sha256"))
    return rows.select("path", F.to_json(F.struct("entity", "evidence", "kind", "path", record_id.alias("record_id"), "sha256")).alias("record"))


def verify(outputs: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, entity, detail): files of an artifact (path, content) that are missing, unplanned or changed."""
    difference = closure.diff(manifest(outputs), manifest(found), "path", "raw_sha256")
    return difference.select(F.lit("artifact").alias("rule"), F.col("path").alias("entity"), F.col("state").alias("detail"))


def explain(records: DataFrame, path: str) -> str:
    """The one provenance record of a path; none or several raise."""
    found = records.where(F.col("path") == path).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} records of {path!r}")
    return found[0].record


def publish(outputs: DataFrame, folder: str) -> None:
    """Write outputs as files of a new folder: tasks write into a hidden sibling, which is renamed; an existing one raises.

    The folder must be on a disk that driver and executors share.
    """
    import os
    from collections.abc import Iterator

    import pandas as pd

    from lakeloom.session import ship

    if os.path.lexists(folder):
        raise FileExistsError(folder)
    hidden = os.path.join(os.path.dirname(os.path.abspath(folder)), f".{os.path.basename(folder)}.partial")
    bad = outputs.select("path", names.column(names.output_path_problem)("path").alias("problem")).where("problem IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].path!r}: {bad[0].problem}")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                own = os.path.join(hidden, path)
                os.makedirs(os.path.dirname(own), exist_ok=True)
                with open(f"{own}.{os.getpid()}", "wb") as f:
                    f.write(content)
                os.replace(f"{own}.{os.getpid()}", own)  # a task that runs twice writes the same
            yield part[["path"]]

    ship(outputs.sparkSession)
    os.makedirs(hidden, exist_ok=True)
    outputs.select("path", "content").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    os.rename(hidden, folder)
