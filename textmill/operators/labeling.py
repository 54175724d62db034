"""Domain labels by keyword, and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(title: Column, domains: list[tuple[str, list[str]]]) -> Column:
    """The first domain of the list with a keyword in the lower-cased title (as a substring), or null."""
    low = F.lower(title)
    found = F.lit(None).cast("string")
    for name, words in reversed(domains):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def label_domains(jobs: DataFrame, domains: list[tuple[str, list[str]]], title: str = "title") -> DataFrame:
    """Jobs with title_lower and assigned_domain, without those of no domain (null titles have none)."""
    return jobs.withColumns({"title_lower": F.lower(title), "assigned_domain": first_match(F.col(title), domains)}).filter("assigned_domain is not null")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows (value, n), most frequent first; nulls are left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def seeded(seed: int, *keys: str) -> Column:
    """A digest to order by: a random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def balanced_sample(rows: DataFrame, group: str, key: str, n: int = 110, seed: int = 42) -> DataFrame:
    """At most n rows of each group, in seeded order. Catalyst cuts each task's groups to n before the shuffle."""
    by = Window.partitionBy(group).orderBy("__order", key)
    return rows.withColumn("__order", seeded(seed, key)).withColumn("__rn", F.row_number().over(by)).filter(F.col("__rn") <= n).drop("__order", "__rn")
