"""Request-shaped entry points: what an HTTP layer would call. The layer itself is not part of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mask_personal, word_count
from ..functions.vectors import HashingEncoder, cosine, encode
from ..operators.explain import explain
from ..operators.ranking import rank_texts
from ..sources.readers import extract_pdfs, pdf_pages


class BadRequest(ValueError):
    """The caller's input can't be used."""


def health() -> dict:
    return {"status": "ok"}


def upload_pdf(spark: SparkSession, name: str, content: bytes, pages_of=pdf_pages) -> dict:
    """{filename, text, pages, word_count} of a PDF file, personal data masked."""
    if not name.lower().endswith(".pdf"):
        raise BadRequest("only PDF files")
    rows = extract_pdfs(spark.createDataFrame([(name, bytearray(content))], "path string, content binary"), "\n", pages_of)
    row = rows.select(mask_personal(F.col("text")).alias("text"), "pages", "error").withColumn("word_count", word_count(F.col("text"))).first()
    if row["error"] or not row["text"].strip():
        raise BadRequest("no text in the file")
    return {"filename": name, "text": row["text"], "pages": row["pages"], "word_count": row["word_count"]}


def rank(spark: SparkSession, job_text: str, resumes: DataFrame, top_k: int | None = None, encoder=None) -> list[dict]:
    try:
        return [r.asDict() for r in rank_texts(spark, job_text, resumes, encoder or HashingEncoder(), top_k).orderBy("rank").collect()]
    except ValueError as e:
        raise BadRequest(str(e)) from e


def rank_pdfs(spark: SparkSession, job_text: str, files: DataFrame, top_k: int | None = None, encoder=None, pages_of=pdf_pages) -> list[dict]:
    """rank() over PDF files (path, content), masked like uploads."""
    texts = extract_pdfs(files, "\n", pages_of).select(F.col("path").alias("resume_id"), mask_personal(F.col("text")).alias("text")).filter("text <> ''")
    return rank(spark, job_text, texts, top_k, encoder)


def explain_match(spark: SparkSession, job_text: str, resume_text: str, vocabulary: list[str] | None = None, encoder=None) -> dict:
    run = encode(encoder or HashingEncoder())
    rows = spark.createDataFrame([("job", "resume", job_text, resume_text)], "job_id string, resume_id string, job_text string, resume_text string")
    rows = rows.withColumn("similarity", cosine(run("job_text"), run("resume_text"))).withColumn("overall_score", F.col("similarity"))
    return explain(rows, vocabulary).first().asDict(recursive=True)


def stats(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {name: rows.count() for name, rows in tables.items()}


def display(score):
    """Columns that a page shows: percent and level of a score from 0 to 1."""
    return F.round(score * 100, 1).alias("score_pct"), F.when(score * 100 >= 60, "high").when(score * 100 >= 35, "medium").otherwise("low").alias("level")
