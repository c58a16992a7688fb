"""Queries against their DuckDB SQL."""

from collections import Counter

import duckdb
import pytest

from lakeloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, sf):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = db.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    assert Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
