"""TF-IDF in long form: rows (id, term, weight) of unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..config import ENGLISH_STOP_WORDS
from ..functions.text import tokens
from .search import ROWS, nearest_sparse


def _token_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, tokens) of ids that stand in one row, and those of ids that stand in several, if there are any.

    What an id's only row holds is counted inside that row, without a shuffle of terms."""
    ids = docs.select(F.col(id_col).alias("__id")).groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col), 2).alias("tokens"))
    if ids.isEmpty():
        return rows, None
    same = F.col("id").eqNullSafe(F.col("__id"))
    return rows.join(ids, same, "left_anti"), rows.join(ids, same, "left_semi")


def _by_row(rows: DataFrame, lists: Callable, *columns: str) -> DataFrame:
    """Rows (id, *columns) in place of rows (id, tokens): lists(row, tokens) gives (row, column...) of equally many places."""
    kinds = [c.split()[1] for c in columns]
    schema = StructType([rows.schema["id"], *[StructField(c.split()[0], ArrayType(_KINDS[k][0])) for c, k in zip(columns, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                row, *values = lists(np.repeat(np.arange(batch.num_rows), batch.column("tokens").value_lengths().to_numpy()), batch.column("tokens").flatten())
                cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                arrays = [pa.ListArray.from_arrays(cuts, v if isinstance(v, pa.Array) else pa.array(v, _KINDS[k][1])) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


_KINDS = {"string": (StringType(), pa.string()), "int": (IntegerType(), pa.int32()), "long": (LongType(), pa.int64()), "double": (DoubleType(), pa.float64())}


def _counts(row: np.ndarray, flat: pa.Array) -> tuple:
    """Each row's distinct tokens and how often they stand there."""
    words = flat.dictionary_encode()
    n = max(1, len(words.dictionary))
    each, tf = np.unique(row * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return each // n, words.dictionary.take(pa.array(each % n)), tf


def term_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """Rows (id, term, tf) of words of two characters or more. Only terms of repeated ids are shuffled, to be added up."""
    words = ENGLISH_STOP_WORDS if stop_words is None else stop_words

    def listed(rows: DataFrame) -> DataFrame:
        out = _by_row(rows, _counts, "term string", "tf long").select("id", F.explode(F.arrays_zip("term", "tf")).alias("x")).select("id", "x.term", "x.tf")
        return out.filter(~F.col("term").isin(words)) if words else out

    once, again = _token_rows(docs, id_col, text_col)
    return listed(once) if again is None else listed(once).unionByName(listed(again).groupBy("id", "term").agg(F.sum("tf").alias("tf")))


def fit(docs: DataFrame, id_col: str = "id", text_col: str = "text", max_terms: int = 5000, stop_words: list[str] | None = None) -> DataFrame:
    """Rows (term, df, idf) of the max_terms terms with the most occurrences (ties: the lesser term).

    idf = ln((1 + n) / (1 + df)) + 1, n being all documents, those without terms included. At most max_terms rows."""
    counts = term_frequencies(docs, id_col, text_col, stop_words).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = counts.orderBy(F.desc("total"), "term").limit(max_terms)
    n = docs.agg(F.count("*").alias("n"))
    return kept.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def fitted(docs: DataFrame, id_col: str = "id", text_col: str = "text", max_terms: int = 5000, stop_words: list[str] | None = None) -> DataFrame:
    """fit(), computed now and held by the driver: at most max_terms rows, so that later uses don't count terms again."""
    rows = fit(docs, id_col, text_col, max_terms, stop_words)
    return docs.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)


def _known(vocabulary: DataFrame, stop_words: list[str] | None) -> tuple[pa.Array, np.ndarray]:
    """Terms in order and their idf. fit() has bounded them, so the driver holds them and they go out with the tasks."""
    stop = set(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    known = sorted((r["term"], r["idf"]) for r in vocabulary.select("term", "idf").collect() if r["term"] not in stop)
    return pa.array([t for t, _ in known], pa.string()), np.array([i for _, i in known], float)


def _weighted(docs: DataFrame, terms: pa.Array, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, at array<int>, weight array<double>), one for each id: its unit vector over the known terms, by place."""

    def found(row: np.ndarray, flat: pa.Array) -> tuple:
        at = pc.fill_null(pc.index_in(flat, terms), -1).to_numpy(zero_copy_only=False)
        each, tf = np.unique(row[at >= 0] * max(1, len(terms)) + at[at >= 0], return_counts=True)
        return *np.divmod(each, max(1, len(terms))), tf

    def unit(row: np.ndarray, flat: pa.Array) -> tuple:
        row, at, tf = found(row, flat)
        raw = tf * idf[at]
        return row, at, raw / np.sqrt(np.bincount(row, raw * raw))[row] if len(row) else raw

    once, again = _token_rows(docs, id_col, text_col)
    out = _by_row(once, unit, "at int", "weight double")
    if again is None:
        return out
    # of a repeated id no more than the known terms are gathered
    ids = again.select("id").distinct()
    sums = _by_row(again, found, "at int", "tf long").select("id", F.explode(F.arrays_zip("at", "tf")).alias("x")).groupBy("id", F.col("x.at").alias("at")).agg(F.sum("x.tf").alias("tf"))
    known = docs.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(idf)], "at int, idf double")
    lists = sums.join(F.broadcast(known), "at").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("tf") * F.col("idf")).alias("raw")))).alias("x"))
    lists = lists.select(F.col("id").alias("__id"), "x", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v["raw"] * v["raw"])).alias("length"))
    none = F.array().cast("array<double>")
    both = ids.join(lists, F.col("id").eqNullSafe(F.col("__id")), "left")
    both = both.select("id", F.coalesce(F.col("x.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.transform("x", lambda v: v["raw"] / F.col("length")), none).alias("weight"))
    return out.unionByName(both)


def transform(docs: DataFrame, vocabulary: DataFrame, id_col: str = "id", text_col: str = "text", stop_words: list[str] | None = None, sizes: bool = False) -> DataFrame:
    """Rows (id, term, weight), of unit length for each id; sizes adds n_terms, how many an id has. Made inside a
    document's row."""
    terms, idf = _known(vocabulary, stop_words)
    rows = _weighted(docs, terms, idf, id_col, text_col).select("id", F.size("at").alias("n_terms"), F.explode(F.arrays_zip("at", "weight")).alias("x"))
    names = F.lit(terms.to_pylist()) if len(terms) else F.array().cast("array<string>")
    return rows.select("id", F.get(names, F.col("x.at")).alias("term"), F.col("x.weight").alias("weight"), *(["n_terms"] if sizes else []))


def similarities(left: DataFrame, right: DataFrame, left_id: str = "job_id", right_id: str = "resume_id") -> DataFrame:
    """Rows (left, right, score): cosines over 0 of unit vectors, by a join on shared terms. Other pairs have 0."""
    a = left.select(F.col("id").alias(left_id), "term", F.col("weight").alias("w1"))
    b = right.select(F.col("id").alias(right_id), "term", F.col("weight").alias("w2"))
    return a.join(b, "term").groupBy(left_id, right_id).agg(F.sum(F.col("w1") * F.col("w2")).alias("score"))


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "job_id", right_id: str = "resume_id") -> DataFrame:
    """pairs plus score: the cosine of the vectors() of both ids, 0 where one is missing. Only listed pairs are computed; a
    vector is one row, and travels once for each of its side's pairs at most."""
    side = lambda rows, key, name: rows.select(F.col("id").alias(key), F.col("vector.at").alias(f"__{name}_at"), F.col("vector.weight").alias(f"__{name}_weight"))
    rows = pairs.join(side(left, left_id, "left"), left_id, "left").join(side(right, right_id, "right"), right_id, "left")
    return rows.select(*pairs.columns, _dot("__left_at", "__left_weight", "__right_at", "__right_weight").alias("score"))


@F.arrow_udf(DoubleType())
def _dot(left_at: pa.Array, left_weight: pa.Array, right_at: pa.Array, right_weight: pa.Array) -> pa.Array:
    """Products of sparse vectors whose places rise."""

    def flat(at: pa.Array, weight: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(at)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
        return (row << 32) + at.flatten().to_numpy(zero_copy_only=False), weight.flatten().to_numpy(zero_copy_only=False)

    out = np.zeros(len(left_at))
    for i in range(0, len(out), ROWS):
        (a, x), (b, y) = (flat(at.slice(i, ROWS), weight.slice(i, ROWS)) for at, weight in ((left_at, left_weight), (right_at, right_weight)))
        both, of_a, of_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        part = out[i : i + ROWS]
        part += np.bincount(both >> 32, x[of_a] * y[of_b], minlength=len(part))
    return pa.array(out)


def vectors(docs: DataFrame, vocabulary: DataFrame, id_col: str = "id", text_col: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """Rows (id, vector array<struct<at, weight>>) for all ids: places of terms in the order of the vocabulary, which
    fit() has bounded. Ids without terms have an empty vector. Made inside a document's row."""
    return _weighted(docs, *_known(vocabulary, stop_words), id_col, text_col).select("id", F.arrays_zip("at", "weight").alias("vector"))


def nearest(left: DataFrame, right: DataFrame, width: int, k: int, digits: int = 9) -> DataFrame:
    """Rows (job_id, resume_id, score): for each of left the k of right with the greatest product of vectors() over 0, the
    lesser id first among equals. A task keeps k of its rows for each of left; only these are shuffled."""
    best = nearest_sparse(left, right, width, k, digits=digits, positive=True)
    return best.select(F.col("q").alias("job_id"), F.col("d").alias("resume_id"), "score")


def extremes(left: DataFrame, right: DataFrame, width: int, k: int, digits: int = 9) -> DataFrame:
    """Rows (job_id, resume_id, score, label): for each of left the k of right with the greatest product of vectors() as 1
    (the greater id first among equals) and the k with the least as 0 (the lesser first), products of 0 included."""
    best = nearest_sparse(left, right, width, k, largest=True, later_first=True, digits=digits)
    worst = nearest_sparse(left, right, width, k, largest=False, digits=digits)
    pick = lambda rows, label: rows.select(F.col("q").alias("job_id"), F.col("d").alias("resume_id"), "score", F.lit(label).alias("label"))
    return pick(best, 1).unionByName(pick(worst, 0))
