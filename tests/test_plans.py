"""Vaults, resolution, closure and artifacts on small hand-made inputs."""

import io
import os
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import SparkSession

from lakeloom.operators import approval, dedup, journal, notes, sensitive
from lakeloom.plans import artifact, canvas, markdown
from lakeloom.sources import vaults


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


FILES = {"a/One.md": b"# One\n[[two]] [[Gone]] [x](../b/Two.md#Part) [[Two#Nope]] ![[p.png]]\n", "b/Two.md": b"---\naliases: [deux]\n---\n## Part\n[[DEUX]] [[../../out]]\n", "c/two.md": b"x\n", "p.png": b"\x89PNG", ".git/x.md": b"no", "id_rsa": b"no", "tmp/y.md": b"no", "C.canvas": b'{"nodes":[{"id":"1","type":"file","file":"a/One.md"}]}'}


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for k, v in files.items():
            info = tarfile.TarInfo(k)
            info.size = len(v)
            t.addfile(info, io.BytesIO(v))
        link = tarfile.TarInfo("link.md")
        link.type, link.linkname = tarfile.SYMTYPE, "a/One.md"
        t.addfile(link)
    return zstandard.ZstdCompressor().compress(out.getvalue())


def test_sources_agree(spark, tmp_path):
    for k, v in FILES.items():
        path = tmp_path / "dir" / k
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(v)
    (tmp_path / "v.zip").write_bytes(zipped(FILES))
    (tmp_path / "v.tar.zst").write_bytes(tarred(FILES))
    want = sorted(k for k in FILES if k not in (".git/x.md", "id_rsa", "tmp/y.md"))
    ids = set()
    for source in ("dir", "v.zip", "v.tar.zst"):
        files = vaults.scan(spark, "s", str(tmp_path / source), ["tmp/"])
        rows = files.collect()
        assert sorted(r.logical_path for r in rows) == want and all(FILES[r.logical_path] == bytes(r.content) and r.problem is None for r in rows)
        ids.add((vaults.snapshot_id(files, "s"), vaults.content_id(files, "s")))
    assert len(ids) == 1
    assert vaults.discover(str(tmp_path))[0] == [str(tmp_path / "v.tar.zst"), str(tmp_path / "v.zip"), str(tmp_path / "dir" / "a"), str(tmp_path / "dir" / "b"), str(tmp_path / "dir" / "c"), str(tmp_path / "dir" / "tmp")]
    with pytest.raises(ValueError):
        vaults.inspect(spark, {"a": str(tmp_path), "b": str(tmp_path / "dir")})


def test_bad_archives(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 no")
    (tmp_path / "cut.zip").write_bytes(zipped(FILES)[:-30])
    (tmp_path / "big.zip").write_bytes(zipped({"a.md": b"x" * 3000, "../up.md": b"x", "con.md": b"x"}))
    rows = vaults.scan(spark, "s", str(tmp_path / "*.zip"), limits=vaults.Limits(file_bytes=1000)).collect()
    assert sorted(r.problem for r in rows) == sorted(["file too large", "not portable", "reserved", *(r.problem for r in rows if r.problem.startswith("not a ZIP"))]) and len(rows) == 5
    (tmp_path / "x.tzst").write_bytes(b"nothing")
    assert vaults.scan(spark, "s", str(tmp_path / "x.tzst")).collect()[0].problem.startswith("not a tar.zst")
    assert vaults.zip_entries(b"", vaults.Limits()).__next__()[2].startswith("not a ZIP")


def test_ignore_patterns():
    import re

    rule = re.compile(vaults.ignore_regex(["*.tmp", "/build", "docs/**/x.md", "cache/", "n[!a].md", "# no"]))
    assert [p for p in ("a.tmp", "d/b.tmp", "build/x", "d/build", "docs/a/b/x.md", "docs/x.md", "cache/q", "q/cache/z", "cache", "nb.md", "na.md") if rule.search(p)] == ["a.tmp", "d/b.tmp", "build/x", "docs/a/b/x.md", "docs/x.md", "cache/q", "q/cache/z", "nb.md"]
    with pytest.raises(ValueError):
        vaults.ignore_regex(["!x"])


def test_objects(tmp_path):
    digest = vaults.put_object(str(tmp_path), b"x")
    assert vaults.put_object(str(tmp_path), b"x") == digest and vaults.read_object(str(tmp_path), digest) == b"x"
    (tmp_path / digest[:2] / digest).write_bytes(b"y")
    with pytest.raises(ValueError):
        vaults.read_object(str(tmp_path), digest)


def vault(spark, files=FILES):
    return spark.createDataFrame([("v", k, bytearray(v)) for k, v in files.items() if k.endswith(".md")], "source_id string, logical_path string, content binary")


def test_resolution(spark):
    docs = markdown.parse_notes(vault(spark, {k: v for k, v in FILES.items() if k[0] in "abc"}))
    assets = spark.createDataFrame([("v", "a/p.png", "asset", "asset_1"), ("v", "C.canvas", "canvas", "canvas_1")], "source_id string, logical_path string, kind string, target string")
    paths = {r.document_id: r.logical_path for r in docs.collect()}
    got = {(paths[r.document_id], r.ordinal): (r.resolution, paths.get(r.target, r.target)) for r in notes.resolve_links(docs, assets).collect()}
    assert got == {("a/One.md", 0): ("ambiguous", None), ("a/One.md", 1): ("unresolved", None), ("a/One.md", 2): ("resolved", "b/Two.md"), ("a/One.md", 3): ("unresolved", None), ("a/One.md", 4): ("asset", "asset_1"), ("b/Two.md", 0): ("resolved", "b/Two.md"), ("b/Two.md", 1): ("unresolved", None)}
    refs = spark.createDataFrame([("r1", "v", "C.canvas", "a/One.md"), ("r2", "v", "C.canvas", "c.canvas"), ("r3", "v", "C.canvas", "two"), ("r4", "v", "C.canvas", "../z"), ("r5", "v", "C.canvas", None)], "ref_id string, source_id string, logical_path string, path string")
    assert {r.ref_id: (r.resolution, r.kind) for r in notes.resolve_canvas(refs, docs, assets).collect()} == {"r1": ("resolved", "document"), "r2": ("resolved", "canvas"), "r3": ("ambiguous", None), "r4": ("unresolved", None), "r5": ("unresolved", None)}
    assert [r.ref_id for r in notes.escaping_targets(refs).collect()] == ["r4"]
    assert [(r.key, r.n_documents) for r in notes.lookup_conflicts(docs).collect()] == [("two", 2)]


def test_rewriting(spark):
    files = {"a/One.md": "é [x](../b/Two.md#P) [[Two|t]]\n".encode(), "b/Two.md": b"# P\n"}
    docs = markdown.parse_notes(vault(spark, files))
    outputs = docs.selectExpr("document_id AS id", "CASE logical_path WHEN 'b/Two.md' THEN 'new dir/Two~1.md' ELSE logical_path END AS path")
    changes = notes.replacements(docs, notes.resolve_links(docs), outputs)
    assert notes.overlapping(changes).count() == 0
    held = vault(spark, files).join(docs.select("logical_path", "document_id"), "logical_path")
    done = {r.document_id: bytes(r.content).decode() for r in notes.splice(held, changes).collect()}
    assert sorted(done.values()) == ["# P\n", "é [x](../new%20dir/Two~1.md#P) [[../new dir/Two~1.md|t]]\n"]


def test_path_rules(spark):
    paths = spark.createDataFrame([(1, "a/b.md"), (2, "A/c.md"), (3, "x"), (4, "x/y.md"), (5, "z.md"), (6, "z.md"), (7, None)], "id int, path string")
    assert {(r.key, r.rule) for r in notes.path_conflicts(paths).collect()} == {("a", "spelling"), ("x", "file and folder"), ("z.md", "repeated")}
    given = notes.allocate(paths.withColumnRenamed("path", "logical_path").where("logical_path IS NOT NULL")).collect()
    assert len({r.path for r in given}) == 6 and [r.conflict for r in given if r.conflict] == ["exact"]


def closure_tables(spark):
    make = spark.createDataFrame
    return {
        "documents": make([("d1", "s", "a.md"), ("d2", "s", "b.md")], "document_id string, source_id string, logical_path string"),
        "blocks": make([("b1", "d1", "h1"), ("b2", "d2", "h2")], "block_id string, document_id string, content_hash string"),
        "metadata": make([("m1", "d1", "k", 0)], "metadata_id string, document_id string, key string, value_index int"),
        "clusters": make([("c1", "T", "t.md", ["d1", "d2"])], "cluster_id string, title string, canonical_path string, document_ids array<string>"),
        "dispositions": make([("c1", "b1", "integrated", None), ("c1", "b2", "omitted", "why"), ("c1", "m1", "preserved", None)], "cluster_id string, target string, kind string, rationale string"),
        "sections": make([("c1", "s1")], "cluster_id string, section_id string"),
        "cited": make([("c1", "s1", "d1", "b1", "h1")], "cluster_id string, section_id string, document_id string, block_id string, content_hash string"),
        "omissions": make([("c1", "b2")], "cluster_id string, target string"),
        "related": make([("c1", "c1")], "cluster_id string, other string"),
        "claims": make([("c1", "x", "q1", 1), ("c1", "x", "q2", 2)], "cluster_id string, contradiction_id string, claim_id string, n_evidence int"),
    }


def rules(df):
    return sorted({r.rule for r in df.collect()})


def test_closure(spark):
    t = closure_tables(spark)
    args = ("clusters", "blocks", "metadata", "dispositions", "sections", "cited", "omissions", "related", "claims")
    check = lambda **other: rules(approval.revision(*({**t, **other}[a] for a in args)))
    assert check() == []
    assert check(dispositions=t["dispositions"].where("target <> 'm1'")) == ["disposition"]
    assert check(omissions=t["omissions"].limit(0), cited=t["cited"].limit(0)) == ["integrated but not cited", "omission approval", "section without evidence"]
    assert check(claims=t["claims"].where("claim_id = 'q1'"), related=t["related"].selectExpr("cluster_id", "'c9' AS other")) == ["contradiction of one claim", "related cluster"]
    assert rules(approval.taxonomy(t["clusters"], t["documents"])) == []
    assert rules(approval.taxonomy(t["clusters"].selectExpr("cluster_id", "title", "'../x.txt' AS canonical_path", "array('d1', 'd9') AS document_ids"), t["documents"])) == ["cluster path", "document coverage"]
    assert rules(approval.evidence(t["cited"].selectExpr("cluster_id", "section_id", "document_id", "block_id", "'forged' AS content_hash"), t["clusters"], t["blocks"])) == ["evidence"]
    with pytest.raises(ValueError, match="disposition"):
        approval.require(approval.revision(*(t[a] if a != "dispositions" else t[a].limit(0) for a in args)))


def test_corpus_and_critic(spark):
    t = closure_tables(spark)
    blocks = t["blocks"].selectExpr("block_id", "document_id", "sha2(block_id, 256) AS content_hash", "block_id AS text")
    assert rules(approval.corpus(t["documents"], blocks, t["metadata"])) == []
    assert rules(approval.corpus(t["documents"].union(t["documents"].limit(1)), blocks.selectExpr("block_id", "'d9' AS document_id", "content_hash", "'x' AS text"), t["metadata"])) == ["block hash", "block of no document", "legacy path", "repeated document", "repeated path"]
    assert "empty corpus" in rules(approval.corpus(t["documents"].limit(0), blocks, t["metadata"]))
    findings = spark.createDataFrame([("c", "f1", "minor"), ("c", "f2", "critical"), ("c", "f3", None)], "cluster_id string, finding_id string, severity string")
    assert rules(approval.critic(findings, findings.limit(0).select("cluster_id", "finding_id"))) == ["blocking finding", "waiver"]
    recorded = spark.createDataFrame([("r1",), ("r1",)], "recording string")
    assert rules(approval.recordings(recorded, "r2")) == ["no organizer recording", "repeated recording"]


def test_artifact(spark, tmp_path):
    t = closure_tables(spark)
    sections = spark.createDataFrame([("c1", 2, "B", "two"), ("c1", 1, "A", None)], "cluster_id string, ordinal int, heading string, body string")
    meta = spark.createDataFrame([("c1", "k", 'v"w')], "cluster_id string, key string, value string")
    outputs = artifact.materialize(t["documents"], t["clusters"], sections, meta)
    made = {r.path: bytes(r.content).decode() for r in outputs.collect()}
    assert made["t.md"] == '---\ncluster: "c1"\nk: "v\\"w"\n---\n\n# T\n\n## A\n\n\n\n## B\n\ntwo\n' and made["legacy/a.md"] == "Moved to [T](../t.md).\n" and len(made) == 3
    artifact.publish(outputs, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        artifact.publish(outputs, str(tmp_path / "out"))
    found = lambda: vaults.scan(spark, "o", str(tmp_path / "out")).selectExpr("logical_path AS path", "content")
    assert artifact.verify(outputs, found()).count() == 0
    os.remove(tmp_path / "out" / "t.md")
    assert [(r.entity, r.detail) for r in artifact.verify(outputs, found()).collect()] == [("t.md", "removed")]
    records = artifact.provenance(outputs, t["cited"].select("cluster_id", "block_id"))
    assert '"evidence":["b1"]' in artifact.explain(records, "t.md")
    with pytest.raises(LookupError):
        artifact.explain(records, "none")
    assert len(artifact.checksum_hash(artifact.manifest(outputs))) == 64


def test_greedy_cap(spark):
    import random

    rng = random.Random(3)
    pairs = sorted({(i, j) for i, j in ((rng.randrange(12), rng.randrange(12)) for _ in range(70)) if i < j})
    scored = [(i, j, round(rng.random(), 1)) for i, j in pairs]
    want, used = set(), {}
    for s, i, j in sorted((-s, i, j) for i, j, s in scored):
        if used.get(i, 0) < 3 and used.get(j, 0) < 3:
            want.add((i, j))
            used[i], used[j] = used.get(i, 0) + 1, used.get(j, 0) + 1
    got = dedup.greedy_cap(spark.createDataFrame(scored, "left long, right long, similarity double"), 3)
    assert {(r.left, r.right) for r in got.collect()} == want
    assert dedup.published_signature("abc", "d") is None and len(dedup.published_signature("abcdef", "d", 4)) == 4


def test_journal_and_disclosure(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "sequence long, v string")
    more = spark.createDataFrame([("d",), ("c",), ("e",)], "v string")
    assert [(r.sequence, r.v) for r in journal.append(rows, more, "v").orderBy("sequence").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    texts = spark.createDataFrame([(1, "mail a@b.c"), (2, None), (3, "x")], "k long, text string")
    found = sensitive.find(texts, "k")
    assert [(r.k, r.category, r.byte_start, r.byte_end) for r in found.collect()] == [(1, "email", 5, 10)]
    allowed = lambda keys: {r.stage: r.remote_allowed for r in sensitive.authorize(found, spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()}
    assert allowed([3]) == {"embedding": False, "organizer": False, "synthesis": True, "critic": True} and not allowed([1])["critic"]


def test_canvases(spark):
    files = spark.createDataFrame([("a", bytearray(b'{"nodes":[{"id":"1","type":"text"}],"edges":[{"id":"e","fromNode":"1","toNode":"2"}]}')), ("b", None), ("c", bytearray(b"[]"))], "logical_path string, content binary")
    got = canvas.parse_canvases(files)
    assert {r.logical_path: bool(r.error) for r in got.collect()} == {"a": False, "b": True, "c": True}
    assert [(r.edge, r.node) for r in canvas.dangling_edges(got).collect()] == [("e", "2")]
