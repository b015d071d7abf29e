"""Evaluation queries against their SQL."""

import duckdb
import pytest

from lorekeep.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_weight_sweep_equals_its_sql(spark, tables):
    got = [tuple(r) for r in QUERIES["eval_weight_sweep"](spark, SF).orderBy("w").collect()]
    want = sorted(tables.execute(ORACLES["eval_weight_sweep"]).fetchall())
    assert [w for w, *_ in got] == [0.0, 0.1, 0.3, 0.5]
    assert got == [tuple(map(float, row)) for row in want]
