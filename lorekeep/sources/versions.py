"""A table in versions, of which a write replaces only the partitions that it touches.

Data files lie in a folder per write, below it in one per partition value. A version is a manifest: for each value, the
folder that holds its rows. The next version keeps the entries of all other values, so what a write costs
goes with the rows of the values that it touches, and readers of older versions are undisturbed. A version exists
once its manifest does, and a write that is repeated after a failure makes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "value string, folder string, n long"


class Versions:
    """`by`: the column whose values are replaced as a whole; `schema` holds all columns, `by` among them."""

    def __init__(self, spark: SparkSession, base: str, schema: str, by: str) -> None:
        self.spark, self.base, self.schema, self.by = spark, base, schema, by

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/version={version}")

    def latest(self) -> int:
        """The last version whose manifest is complete."""
        version = 0
        while self._exists(f"{self.base}/manifest/version={version + 1}/_SUCCESS"):
            version += 1
        return version

    def read(self, version: int, values: DataFrame | None = None) -> DataFrame:
        """Rows of a version; with `values` (column `by`) those of these values, of which alone files are listed and read."""
        entries = self.manifest(version)
        if values is not None:
            entries = entries.join(values.select(F.col(self.by).cast("string").alias("value")).distinct(), "value", "left_semi")
        folders = [r.folder for r in entries.select("folder").distinct().collect()]  # one row a value
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        columns = self.spark.createDataFrame([], self.schema).columns
        return self.spark.read.schema(self.schema).parquet(*folders).select(*columns)

    def write(self, version: int, rows: DataFrame, values: DataFrame) -> int:
        """Version `version` + 1: the rows of `values` are replaced by `rows`; a value without rows is gone."""
        new = f"{self.base}/data/version={version + 1}"
        # the value is a column of the files too, so that folders are read one by one
        dealt = rows.withColumn("_value", F.md5(F.col(self.by).cast("string")))
        dealt.repartition("_value").write.mode("overwrite").partitionBy("_value").parquet(new)
        touched = values.select(F.col(self.by).cast("string").alias("value")).distinct()
        own = rows.groupBy(F.col(self.by).cast("string").alias("value")).agg(F.count("*").alias("n")).select("value", F.concat(F.lit(f"{new}/_value="), F.md5("value")).alias("folder"), "n")
        kept = self.manifest(version).join(touched, "value", "left_anti").join(own.select("value"), "value", "left_anti")
        kept.unionByName(own).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/version={version + 1}")  # one row a value
        return version + 1
