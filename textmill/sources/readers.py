"""Readers with declared schemas. No schema is inferred from data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = "job_id bigint, title string, description string"
SKILLS = "skill_abr string, skill_name string"
JOB_SKILLS = "job_id bigint, skill_abr string"
PAIRS = "job_id bigint, resume_id string, label int, jd_domain string, resume_domain string"
RESUMES = "resume_id string, domain string, text string"


class MissingColumn(ValueError):
    """A source lacks a column that it must have."""


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; values may hold line feeds and doubled quotes. Columns are taken by name: one that the
    file lacks is MissingColumn, others are left out."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    names = spark.read.options(**options, inferSchema=False).csv(path).columns
    wanted = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    missing = [c for c in wanted if c not in names]
    if missing:
        raise MissingColumn(f"{path}: no column {', '.join(missing)}")
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    rows = spark.read.options(**options, inferSchema=False).csv(path)
    return rows.select(*[F.expr(f"try_cast(`{c}` as {types[c].simpleString()})").alias(c) for c in wanted])


def resume_csv(spark: SparkSession, path: str, text_col: str = "Resume_str", id_col: str | None = None) -> DataFrame:
    """Rows (resume_id, source, text). Without an id column the id is a digest of the text: row order is no key."""
    wanted = f"{text_col} string" + (f", {id_col} string" if id_col else "")
    rows = csv(spark, path, wanted)
    key = F.col(id_col) if id_col else F.concat(F.lit("csv_"), F.md5(F.coalesce(text_col, F.lit(""))))
    return rows.select(key.alias("resume_id"), F.lit("csv").alias("source"), F.coalesce(text_col, F.lit("")).alias("text"))


def text_directory(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Rows (resume_id, text): one for each file, its name and whole content."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_name").alias("resume_id"), F.col("value").alias("text"))


def pdf_listing(spark: SparkSession, path: str) -> DataFrame:
    """Rows (resume_filename, domain) of PDF files one level down; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -1).alias("resume_filename"), F.element_at(parts, -2).alias("domain"))


def pdf_pages(data: bytes) -> list[str]:
    """Texts of the pages, by the optional library pdfplumber."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as f:
        return [p.extract_text() or "" for p in f.pages]


def extract_pdfs(files: DataFrame, page_sep: str = "", pages_of: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """Rows (path, text, pages, word_count, error) of (path, content); a file that can't be read has its error."""
    schema = "path string, text string, pages int, word_count int, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    pages = pages_of(content)
                    text = page_sep.join(pages)
                    rows.append((path, text, len(pages), len(text.split()), None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, "", 0, 0, f"{type(e).__name__}: {e}"))
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["path", "text", "pages", "word_count", "error"])

    return files.select("path", "content").mapInArrow(read, schema)


def pdf_directory(spark: SparkSession, path: str, page_sep: str = "", pages_of: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """Rows (resume_id, domain, text, pages, word_count, error) of all PDF files below a folder; the id is
    folder_name.txt, the domain the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    rows = extract_pdfs(files, page_sep, pages_of)
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"(?i)\.pdf$", "")
    return rows.select(F.concat_ws("_", F.element_at(parts, -2), F.concat(name, F.lit(".txt"))).alias("resume_id"), F.element_at(parts, -2).alias("domain"), "text", "pages", "word_count", "error")


def domain_dictionary(path: str) -> list[tuple[str, list[str]]]:
    """Domains with their keywords, in the order of the file: the first match wins."""
    with open(path) as f:
        return [(k, list(v)) for k, v in json.load(f).items()]


def as_text_name(column: str):
    """The name of the text made of a PDF: each '.pdf' becomes '.txt'."""
    return F.replace(F.col(column), F.lit(".pdf"), F.lit(".txt"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All logged runs, by name."""
    schema = "run_id string, experiment string, run_name string, started string, elapsed_seconds double, status string, params map<string,string>, tags map<string,string>, metrics map<string,double>"
    return spark.read.schema(schema).json(path).orderBy("started", "run_id")


def describe(rows: DataFrame, n: int = 5) -> tuple[list[tuple[str, str]], list]:
    """Columns with types, and a few rows to look at."""
    return rows.dtypes, rows.limit(n).collect()
