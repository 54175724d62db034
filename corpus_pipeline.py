"""The corpus pipeline: five stages, each an operator of textmill.llm on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. run() writes each stage's rows as Parquet into the shared folder and rereads them for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import lines, mixing, neardup, packing, quality
from textmill.llm.queries import _vocabulary
from textmill.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject.

    A row goes or stays by its own id and text: null and empty texts have the score of texts without words, a null id is
    scored like others, repeated rows share a score. Extra columns are left out; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    scores = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = scores.filter("predicted = 1").select(F.col("doc_id").alias("id"), F.col("text_md5").alias("md5")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("md5"))
    return docs.join(kept, same, "left_semi")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; n_chars follows. A text of which no line is left goes.

    Null and empty texts stay (n_chars of null: 0); a null id counts as the least id; rows alike in id and text are
    treated alike. Extra columns are left out; an empty table stays empty."""
    out = lines.drop_repeated_windows(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least id. A link is a similarity of 0.8 or more.

    Rows without an id stay; null, empty and wordless texts are linked with nothing and stay; rows that repeat an id in
    one group are one document. Extra columns are left out; an empty table stays empty."""
    return neardup.drop_near_duplicates(docs.select(*COLUMNS), percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated towards shares that grow with the square root of a source's size, in shuffled order.

    A null source is a source of its own, a null id draws as 'null', null and empty texts are replicated like others,
    rows of one id get like counts. Extra columns are left out; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    return mixing.replicate(docs, mixing.rates(docs, exponent=0.5), seed=17).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token piece of each row lies in sequences of 2048 tokens.

    Null and empty texts are a piece of the end token; null and repeated ids are packed row by row; extra columns are
    left out; an empty table gives no pieces."""
    return packing.pack(docs.select(*COLUMNS), *_vocabulary(), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and byte-pair encoding can't be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
