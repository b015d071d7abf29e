"""Versions of a table: a write costs what it touches, and older versions stay."""

import os

from pyspark.sql import functions as F

from lorekeep.operators import lenses
from lorekeep.sources.versions import Versions

SCHEMA = "project string, n long"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_only_touched_partitions_are_written(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/t", SCHEMA, "project")
    everything = spark.range(40_000).select(F.concat(F.lit("p/"), (F.col("id") % 40).cast("string")).alias("project"), F.col("id").alias("n"))
    assert store.latest() == 0 and store.read(0).count() == 0
    one = store.write(0, everything, everything.select("project"))
    first = size(tmp_path / "t" / "data" / "version=1")
    touched = spark.createDataFrame([("p/3",), ("gone",), ("p/4",)], "project string")
    two = store.write(one, spark.createDataFrame([("p/3", 7), ("new", 8)], SCHEMA), touched)
    assert (one, two, store.latest()) == (1, 2, 2)
    assert size(tmp_path / "t" / "data" / "version=2") < first / 20
    now = {r.project: (r.c, r.s) for r in store.read(2).groupBy("project").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()}
    assert now["p/3"] == (1, 7) and now["new"] == (1, 8) and "p/4" not in now and now["p/5"][0] == 1000 and len(now) == 40
    assert store.read(1).count() == 40_000
    assert {r.n for r in store.read(2, touched).collect()} == {7}
    # a write that is repeated makes the same version again, and a version without a manifest does not exist
    assert store.write(one, spark.createDataFrame([("p/3", 9)], SCHEMA), touched) == 2 and {r.n for r in store.read(2, touched).collect()} == {9}


def test_rows_are_numbered_in_many_tasks(spark):
    rows = [(None,), ("",), ("b",), ("10",), ("9",), ("a",), ("2.5",)] + [(str(i),) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "v string").repartition(5)
    got = [r.v for r in lenses.numbered(df, lenses.order_keys("v")).orderBy("place").collect()]
    assert got == ["b", "a", *[str(i) for i in range(159, 99, -1)], "10", "9", "2.5", "", None]
