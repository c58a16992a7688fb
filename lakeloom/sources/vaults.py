"""Vaults as tables of files: folders, ZIP archives and zstd-compressed tar archives, on any file system that Spark reads.

A file is (source_id, logical_path, original_path, kind, media_type, byte_len, raw_sha256, file_id, content, problem).
Files of denied names, by ignore patterns, and links are left out. A path that isn't portable, an archive that is
damaged, encrypted, repeats a name or expands beyond its limits give rows with a problem and no content, so that a scan
of many archives ends and says what is wrong. Empty folders give no rows. An archive is read by one task, streaming its
members; a folder by as many tasks as its bytes ask for.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import stat
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import identity, names, text
from lakeloom.session import ship

ENTRY = "archive string, raw_path string, content binary, problem string"
FILE = ("source_id", "logical_path", "original_path", "kind", "media_type", "byte_len", "raw_sha256", "file_id", "content", "problem")


@dataclass(frozen=True)
class Limits:
    """Most bytes of a file, of an archive's content, of its entries, and of content for each stored byte."""

    file_bytes: int = 256 << 20
    archive_bytes: int = 4 << 30
    entries: int = 200_000
    ratio: int = 200

    def problem(self, size: int, total: int, entries: int, stored: int) -> str | None:
        found = {"file too large": size > self.file_bytes, "archive too large": total > self.archive_bytes, "too many entries": entries > self.entries, "expands too much": total > self.ratio * max(stored, 1 << 16)}
        return next((k for k, over in found.items() if over), None)


def source_kind(path: str) -> str:
    """zip, tar_zst or directory, by the name."""
    low = path.lower().rstrip("/")
    return "zip" if low.endswith(".zip") else "tar_zst" if low.endswith((".tzst", ".tar.zst")) else "directory"


def ignore_regex(patterns: list[str]) -> str:
    """A regex of ignore patterns: *, ?, [..], ** over folders; a pattern with a / inside counts from the root, one with a
    / at its end means folders. Negation isn't supported."""
    out = []
    for line in patterns:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        if p.startswith("!"):
            raise ValueError(f"negated pattern {line!r}")
        rooted, folder = "/" in p.rstrip("/"), p.endswith("/")
        body = re.sub(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", lambda m: {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or (m[0].replace("[!", "[^") if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0])), p.strip("/"))
        out.append(("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
    return "|".join(out) or "(?!)"


def zip_entries(data: bytes, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, problem) of the members of an archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            seen, total = set(), 0
            for k, info in enumerate(z.infolist()):
                mode = info.external_attr >> 16
                if info.is_dir() or stat.S_ISLNK(mode):
                    continue
                total += info.file_size
                problem = "repeated name" if info.filename in seen else "encrypted" if info.flag_bits & 1 else "name cut by a NUL" if info.orig_filename != info.filename else limits.problem(info.file_size, total, k + 1, len(data))
                seen.add(info.filename)
                try:
                    # open() compares the local header's name with the central directory's, and read() the checksum.
                    content = None if problem else z.read(info)
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
                    content, problem = None, f"damaged: {e}"[:200]
                yield info.filename, content, problem
    except (zipfile.BadZipFile, OSError, ValueError, struct.error) as e:
        yield "", None, f"not a ZIP archive: {e}"[:200]


def tar_entries(data: bytes, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    """The same of a zstd-compressed tar archive, decompressed as it is read."""
    import zstandard

    try:
        seen, total = set(), 0
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
            for k, info in enumerate(tar):
                if info.isdir() or info.issym() or info.islnk():
                    continue
                total += info.size
                problem = "not a file" if not info.isreg() else "repeated name" if info.name in seen else limits.problem(info.size, total, k + 1, len(data))
                seen.add(info.name)
                yield info.name, None if problem else tar.extractfile(info).read(), problem
                if problem in ("archive too large", "too many entries", "expands too much"):
                    return
    except (tarfile.TarError, OSError, ValueError, EOFError, zstandard.ZstdError) as e:
        yield "", None, f"not a tar.zst archive: {e}"[:200]


DECODED = names.column(lambda p: names.percent_decode(p) or p)
READERS = {"zip": zip_entries, "tar_zst": tar_entries}


def scan(spark: SparkSession, source_id: str, path: str, ignore: list[str] | None = None, limits: Limits = Limits(), namespace: str = "lakeloom") -> DataFrame:  # noqa: B008
    """FILE rows of one source: a folder, or one archive or a folder of archives told by `path`'s ending or glob."""
    ship(spark)
    kind = source_kind(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if kind == "directory":
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
        bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
        prefix = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root)
        raw = F.substring(DECODED(bare), len(prefix) + 2, 1 << 20)
        rows = files.select(F.lit(None).cast("string").alias("archive"), raw.alias("raw_path"), F.when(F.col("length") <= limits.file_bytes, F.col("content")).alias("content"), F.when(F.col("length") > limits.file_bytes, "file too large").alias("problem"))
    else:
        read = READERS[kind]

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for archive, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for entry in read(data, limits):
                        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "raw_path", "content", "problem"), (archive, *entry), strict=True))], schema)

        schema = pa.schema([("archive", pa.string()), ("raw_path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
        rows = files.select("path", "content").mapInArrow(run, ENTRY)
    return described(rows, source_id, ignore or [], namespace)


def described(rows: DataFrame, source_id: str, ignore: list[str], namespace: str) -> DataFrame:
    """FILE rows of ENTRY rows."""
    spell, composed, why = (names.column(lambda p, k=k: names.source_path(p)[k]) for k in range(3))
    raw = F.col("raw_path")
    kept = rows.where(~text.is_excluded(raw) & ~raw.rlike(ignore_regex(ignore)))
    named = kept.select(F.lit(source_id).alias("source_id"), composed(raw).alias("logical_path"), spell(raw).alias("original_path"), "raw_path", "content", F.coalesce("problem", why(raw)).alias("problem"))
    family = F.split(text.media_type(raw), "/")[0]
    parts = (F.encode("logical_path", "UTF-8"), F.encode(text.file_kind(raw), "UTF-8"), F.unhex(F.sha2("content", 256)))
    return named.select(
        "source_id", "logical_path", F.coalesce("original_path", raw).alias("original_path"), text.file_kind(raw).alias("kind"), F.when(text.file_kind(raw) == "asset", text.media_type(raw)).otherwise(F.concat(F.lit("text/"), text.file_kind(raw))).alias("media_type"),
        F.octet_length("content").cast("long").alias("byte_len"), F.sha2("content", 256).alias("raw_sha256"), F.when(family.isNotNull(), identity.parts_hash_of(f"{namespace}:file", *parts)).alias("file_id"), F.when(F.col("problem").isNull(), F.col("content")).alias("content"), "problem",
    )


def violations(files: DataFrame) -> DataFrame:
    """(rule, entity, detail): files with problems, and logical paths that occur more than once in a source."""
    bad = files.where("problem IS NOT NULL").select(F.lit("file").alias("rule"), F.concat_ws(":", "source_id", "original_path").alias("entity"), F.col("problem").alias("detail"))
    twice = files.where("logical_path IS NOT NULL").groupBy("source_id", "logical_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bad.union(twice.select(F.lit("repeated path"), F.concat_ws(":", "source_id", "logical_path"), F.concat(F.col("n").cast("string"), F.lit(" files"))))


def snapshot_id(files: DataFrame, source_id: str, policy: str = "source-1", namespace: str = "lakeloom") -> str:
    """Identity of a source's files: a hash over their paths in byte order and identities, streamed through the driver."""
    rows = files.where((F.col("source_id") == source_id) & F.col("problem").isNull()).select("logical_path", "file_id").orderBy(F.encode("logical_path", "UTF-8"))
    members = ((r.logical_path, bytes.fromhex(r.file_id)) for r in rows.toLocalIterator())
    return "snap_" + identity.manifest_hash(f"{namespace}:snapshot", source_id, policy, members).hex()


def content_id(files: DataFrame, source_id: str, namespace: str = "lakeloom") -> str:
    """The same without the source's name, so that one vault under two names has one identity."""
    rows = files.where((F.col("source_id") == source_id) & F.col("problem").isNull()).select("logical_path", "file_id").orderBy(F.encode("logical_path", "UTF-8"))
    state, comma = hashlib.sha256(f"{namespace}:vault-content\0[".encode()), ""
    for r in rows.toLocalIterator():
        state.update((comma + identity.canonical_json([r.logical_path, r.file_id])).encode())
        comma = ","
    state.update(b"]")
    return state.hexdigest()


def inspect(spark: SparkSession, sources: dict[str, str], **options) -> DataFrame:
    """FILE rows of all sources (source_id -> path); ids are 1 to 128 of [A-Za-z0-9._-] and unique as keys."""
    for s in sources:
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", s) or s in (".", ".."):
            raise ValueError(f"source id {s!r}")
    paths = [os.path.normpath(p) for p in sources.values()]
    if any(a != b and (a + "/").startswith(b + "/") for a in paths for b in paths) or len(set(paths)) < len(paths):
        raise ValueError("sources overlap")
    out = None
    for s, p in sources.items():
        own = scan(spark, s, p, **options)
        out = own if out is None else out.unionByName(own)
    return out


def discover(root: str, most: int = 100_000) -> tuple[list[str], bool]:
    """(folders below root that hold notes or archives, whether all entries were seen), without following links."""
    found, n = [], 0
    for folder, below, files in os.walk(root):
        below[:] = sorted(d for d in below if d not in (".git", ".obsidian") and not os.path.islink(os.path.join(folder, d)))
        n += len(files) + len(below)
        if n > most:
            return found, False
        if any(f.lower().endswith(".md") for f in files):
            found.append(folder)
            below[:] = []
        found += [os.path.join(folder, f) for f in sorted(files) if source_kind(f) != "directory"]
    return found, True


def put_object(store: str, data: bytes) -> str:
    """Store bytes under their hash; what is there stays."""
    digest = hashlib.sha256(data).hexdigest()
    folder = Path(store, digest[:2])
    folder.mkdir(parents=True, exist_ok=True)
    part = folder / f".{digest}.{os.getpid()}"
    part.write_bytes(data)
    try:
        os.link(part, folder / digest)
    except FileExistsError:
        pass
    finally:
        part.unlink()
    return digest


def read_object(store: str, digest: str) -> bytes:
    """The bytes of a hash, which is checked."""
    if not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError(f"not a hash: {digest!r}")
    data = Path(store, digest[:2], digest).read_bytes()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"object {digest} is damaged")
    return data
