"""Computed vectors kept by content: a row is computed once for each text, model and setting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import encode

SCHEMA = "key string, model string, vector array<float>"


class VectorCache:
    """A Parquet folder (key, model, vector). Keys are digests of model, parameters and text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    @staticmethod
    def key(text: str, model: str, params: str = ""):
        return F.md5(F.concat_ws("\u0001", F.lit(model), F.lit(params), F.coalesce(F.col(text), F.lit(""))))

    def encode(self, docs: DataFrame, encoder, id_col: str, text_col: str, params: str = "", batch: int = 64) -> DataFrame:
        """docs' (id, vector). Texts that the cache lacks are encoded once each and appended."""
        keyed = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__text"), self.key(text_col, encoder.name, params).alias("key"))
        known = self.read().filter(F.col("model") == encoder.name)
        misses = keyed.select("key", "__text").join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
        fresh = misses.select("key", F.lit(encoder.name).alias("model"), encode(encoder, batch)("__text").alias("vector"))
        fresh.write.mode("append").parquet(self.path)
        return keyed.join(self.read().dropDuplicates(["key"]).select("key", "vector"), "key").select(id_col, "vector")

    def stats(self) -> dict[str, int]:
        return {r["model"]: r["n"] for r in self.read().groupBy("model").agg(F.count("*").alias("n")).collect()}

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
