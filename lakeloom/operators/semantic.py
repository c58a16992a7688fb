"""Vector validation and top-k cosine neighbours by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def norms(vectors: DataFrame) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("vec_id", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 6).alias("norm"))


def top_k(vectors: DataFrame, least: float, k: int, block: int = 1024) -> DataFrame:
    """For each vector its k most similar later ones (by vec_id) of at least a similarity: exact, block by block.

    Vectors are grouped into blocks; each pair of blocks is one matrix product in one task, whose best k rows alone
    are shuffled.
    """
    n_blocks = max(1, -(-vectors.count() // block))
    rows = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("b"), "vec_id", "embedding")
    pairs = F.expr(f"transform(sequence(0, {n_blocks - 1}), o -> struct(least(b, o) as i, greatest(b, o) as j))")
    dealt = rows.select("b", "vec_id", "embedding", F.explode(pairs).alias("p")).select("p.i", "p.j", "b", "vec_id", "embedding")

    def near(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        b, i, j = table.column("b").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        score = (x[left] @ x[right].T).astype(np.float32)
        p, q = np.nonzero(score >= np.float32(least))
        a, c, s = ids[left[p]], ids[right[q]], score[p, q]
        keep = a < c if i == j else a != c
        a, c, s = np.minimum(a, c)[keep], np.maximum(a, c)[keep], s[keep]
        order = np.lexsort((c, -s, a))
        a, c, s = a[order], c[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        best = place < k
        return pa.table({"vec_id": a[best], "neighbour": c[best], "score": s[best].astype(np.float64)})

    found = dealt.groupBy("i", "j").applyInArrow(near, "vec_id long, neighbour long, score double")
    # Ranks up to k are cut before the exchange, too.
    place = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("vec_id", "neighbour", F.round("score", 5).alias("score"))


def invalid(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, problem): vectors of another length, with null or infinite elements or NaN, or of no length at all."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + F.abs(x.cast("double"))) == 0
    problem = F.when(F.col("embedding").isNull() | (F.size("embedding") != dims), "length").when(bad, "not finite").when(zero, "zero")
    return vectors.select("vec_id", problem.alias("problem")).where("problem IS NOT NULL")
