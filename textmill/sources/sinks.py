"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, replacing what is there."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def corpus(resumes: DataFrame, path: str, key: str = "resume_id") -> None:
    """Resumes as Parquet; an id that occurs twice is an error, not an overwritten file."""
    twice = resumes.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids that occur more than once: {[r[key] for r in twice]}")
    table(resumes, path)


def metadata(rows: DataFrame, path: str) -> None:
    csv(rows.select("resume_filename", "domain"), path)
