"""The stateless text functions on a stream of documents: the same Column expressions as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, word_count
from ..operators.labeling import first_match


def normalize_stream(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs, a stream or a table, with its text normalised and word_count; needs no state and no watermark."""
    out = docs.withColumn(text_col, normalize_text(F.col(text_col), **options))
    return out.withColumn("word_count", word_count(F.col(text_col)))


def label_stream(jobs: DataFrame, domains: list[tuple[str, list[str]]], title: str = "title") -> DataFrame:
    return jobs.withColumn("assigned_domain", first_match(F.col(title), domains)).filter("assigned_domain is not null")
