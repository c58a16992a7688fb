"""JSON canvases as tables of nodes, edges and file references; a malformed canvas is an error row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeloom.functions.identity import canonical_json, strict_json
from lakeloom.session import ship

#: Members with a type of their own; all others are kept as JSON.
NODE = {"id": str, "type": str, "file": str, "x": int, "y": int, "width": int, "height": int}
EDGE = {"id": str, "fromNode": str, "toNode": str, "fromSide": str, "toSide": str, "label": str}
NEEDED = {"nodes": ("id", "type"), "edges": ("id", "fromNode", "toNode")}
SCHEMA = """logical_path string, error string,
nodes array<struct<id:string,type:string,file:string,x:bigint,y:bigint,width:bigint,height:bigint,unknown:string>>,
edges array<struct<id:string,fromNode:string,toNode:string,fromSide:string,toSide:string,label:string,unknown:string>>,
refs array<struct<node_id:string,path:string,subpath:string>>""".replace("\n", " ")


def member(value, kinds: dict, needed: tuple, what: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{what} must be objects")
    for name, kind in kinds.items():
        x = value.get(name)
        if name in value and (not isinstance(x, kind) or isinstance(x, bool) or kind is int and not -(1 << 63) <= x < 1 << 63):
            raise ValueError(f"{what}: {name} must be {'a string' if kind is str else 'an integer'}")
        if name in needed and name not in value:
            raise ValueError(f"{what}: {name} is missing")
    return {n: value.get(n) for n in kinds} | {"unknown": canonical_json({k: v for k, v in value.items() if k not in kinds})}


def parse(content: bytes) -> dict:
    """nodes, edges and refs of a canvas; ValueError says what is wrong."""
    root = strict_json(content)
    if not isinstance(root, dict):
        raise ValueError("the root must be an object")
    lists = {k: root.get(k) if isinstance(root.get(k), list) else [] for k in ("nodes", "edges")}
    nodes = [member(v, NODE, NEEDED["nodes"], "nodes") for v in lists["nodes"]]
    ids = [n["id"] for n in nodes]
    if "" in ids or len(set(ids)) < len(ids):
        raise ValueError("node ids must be unique and not empty")
    files = [(n, v) for n, v in zip(nodes, lists["nodes"], strict=True) if n["type"] == "file"]
    if any(n["file"] is None for n, _ in files):
        raise ValueError("a file node has no file")
    refs = [{"node_id": n["id"], "path": n["file"], "subpath": v.get("subpath") if isinstance(v.get("subpath"), str) else None} for n, v in files]
    return {"nodes": nodes, "edges": [member(v, EDGE, NEEDED["edges"], "edges") for v in lists["edges"]], "refs": sorted(refs, key=lambda r: r["node_id"].encode()), "error": None}


def parse_canvases(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files (logical_path, content); null content counts as empty, which is an error row."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append({"logical_path": path} | parse(content or b""))
                except ValueError as e:
                    rows.append({"logical_path": path, "error": str(e)[:300], "nodes": [], "edges": [], "refs": []})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    ship(files.sparkSession)
    return files.select("logical_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def dangling_edges(canvases: DataFrame) -> DataFrame:
    """(logical_path, edge, node): ends of edges that name no node."""
    nodes = canvases.select("logical_path", F.explode("nodes.id").alias("node"))
    edges = canvases.select("logical_path", F.explode("edges").alias("e"))
    ends = edges.select("logical_path", F.col("e.id").alias("edge"), F.explode(F.array("e.fromNode", "e.toNode")).alias("node"))
    return ends.join(nodes, ["logical_path", "node"], "left_anti").select("logical_path", "edge", "node")
