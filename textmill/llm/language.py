"""Language identification by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODES, chunks, mix64, text_bytes
from .labelled import held_out, one_text_each
from .scratch import discard, quoted, written

#: n-gram lengths in bytes that the kernel blends.
SPECTRUM = (2, 3, 4, 5)
#: n-grams are told apart by this many bits of their hashes. A text of 2 MB has some 100,000 of them, a tenth of the places.
GRAM_BITS = 20
#: Labelled texts learned from, about, evenly over the languages; this many of them at most are landmarks.
TRAIN_ROWS = 4_000
LANDMARKS = 400
RIDGE = 1e-3
#: Languages up to this number are sent to every task with their counts; beyond it these are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[: ord("A")] = 32
_FOLD[[*range(ord("Z") + 1, ord("a")), *range(ord("z") + 1, 0x80)]] = 32


def presence(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted places of the n-grams that occur in its folded bytes, each place once.

    A-Z are lower-cased, all but letters are a space; bytes from 0x80 on count as letters, so accents and other scripts
    are kept. n-grams never cross texts."""
    folded = BYTE_CODES[_FOLD[data]]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = np.zeros(len(data), dtype=np.uint64)
    places = []
    for n in range(1, max(SPECTRUM) + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        value = value[:size] * np.uint64(0x9E3779B97F4A7C15) + folded[n - 1 :]
        if n in SPECTRUM:
            whole = owner[:size] == owner[n - 1 :]
            slot = (mix64(value + np.uint64(n)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
            places.append((slot[whole], np.searchsorted(owner[:size][whole], np.arange(len(offsets)))))
    out, mark = [], np.zeros(1 << GRAM_BITS, dtype=bool)
    for i in range(len(offsets) - 1):
        for slot, bounds in places:
            mark[slot[bounds[i] : bounds[i + 1]]] = True
        found = np.flatnonzero(mark).astype(np.int32)
        mark[found] = False
        out.append(found)
    return out


_HAS_LETTER = r"\p{L}"


class Landmarks:
    """Presence vectors of the landmarks, by n-gram, for kernels of any text with all of them."""

    def __init__(self, marks: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in marks], dtype=float)
        self.places, at = np.unique(np.concatenate([*marks, np.zeros(0, np.int32)]).astype(np.int32), return_inverse=True)
        owner = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        order = np.lexsort((owner, at))
        self.owner, self.at = owner[order].astype(np.int32), at[order]
        self.bounds = np.searchsorted(self.at, np.arange(len(self.places) + 1))
        self.row = np.full(1 << GRAM_BITS, -1, dtype=np.int32)
        self.row[self.places] = np.arange(len(self.places))

    def kernel(self, found: np.ndarray) -> np.ndarray:
        """Shared n-grams over the geometric mean of both numbers of n-grams; 0 for a text without any."""
        rows = self.row[found]
        rows = rows[rows >= 0]
        lo, many = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(many)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - many), many)
        return np.bincount(self.owner[take], minlength=len(self.sizes)) / np.sqrt(np.maximum(self.sizes * len(found), 1))

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight a place and language, from coefficients (landmark, language): the kernel is linear in the unit
        presence vector, so a product with these weights has the value of the kernel against every landmark."""
        out = np.zeros((len(self.places), coefficients.shape[1]))
        np.add.at(out, self.at, (coefficients / np.sqrt(np.maximum(self.sizes, 1))[:, None])[self.owner])
        return out.astype(np.float32)


def fit(marks: np.ndarray, kernels: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """One-versus-rest kernel ridge regression in the Nyström space of the landmarks: languages and, for each landmark
    and language, a coefficient. marks: kernels of landmarks with landmarks; kernels: of training texts with landmarks."""
    names = sorted(set(labels))
    if not names:
        return [], np.zeros((len(marks), 0))
    values, vectors = np.linalg.eigh(marks)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernels @ root
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # rarer languages weigh as much as frequent ones
    kinds, which, many = np.unique(labels, return_inverse=True, return_counts=True)
    weight = (len(labels) / len(kinds) / many)[which]
    return names, root @ np.linalg.solve((z * weight[:, None]).T @ z + RIDGE * len(z) * np.eye(z.shape[1]), (z * weight[:, None]).T @ y)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=1 << 19, rows=256):
        found = presence(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "grams"])


def _kernels(landmarks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 19, rows=256):
            rows = [landmarks.value.kernel(f).astype(np.float32).tobytes() for f in presence(*text_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "kernels"])

    return run


def margins(found: list[np.ndarray], row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The products of unit presence vectors with the folded weights, a row a text."""
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    rows = row[np.concatenate([*found, np.zeros(0, np.int32)])]
    padded = np.concatenate([weights, np.zeros((1, weights.shape[1]), np.float32)])  # row -1: no landmark's n-gram
    out = np.zeros((len(found), weights.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(padded[rows], bounds[some], axis=0) / np.sqrt(np.diff(bounds)[some, None])
    return out


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, row, weights = model.value
        for batch in chunks(batches, limit=1 << 18, rows=128):
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if names:
                margin = margins(presence(*text_bytes(batch.column("text"))), row, weights)
                soft = np.exp(4.0 * (margin - margin.max(axis=1, keepdims=True)))
                soft /= soft.sum(axis=1, keepdims=True)
                kinds = [names[b] if ok else "und" for b, ok in zip(margin.argmax(axis=1), letters, strict=True)]
                scores = np.where(letters, soft.max(axis=1), 0.0)
            else:
                kinds, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kinds, pa.string()), pa.array(scores.astype(float))], names=["doc_id", "lang_pred", "score"])

    return score


def _sampled(usable: DataFrame, train_rows: int) -> DataFrame:
    """About `train_rows` rows of usable (doc_id, text, lang): all languages get an equal share, or all rows they have.
    Up to `train_rows` languages are all learned: the row of the least hash of each stays in any case. Of more languages,
    each is drawn as likely as its share says."""
    share = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(share).alias("least")), "languages")
    each = train_rows / max(1, counts.count())
    asked = counts.select("lang", (F.lit(each) / F.col("n")).alias("limit"), (F.col("least") if each >= 1 else F.lit(-1.0)).alias("least"))
    if counts.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        asked = F.broadcast(asked)
    return usable.join(asked, "lang").filter((share < F.col("limit")) | (share == F.col("least"))).select("doc_id", "text", "lang")


def languages(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every document.

    Learned from text and non-null lang of about `train_rows` documents whose crc32(id) mod 4 isn't 2, as many of each
    language as there are or an equal share. The score is the share of the best language in a softmax of the margins.

    Defined results: a null text or one without a letter is 'und' with score 0; without labelled rows all are 'und'; a
    null id is held out and predicted; repeated ids are predicted each, and the least of their texts is learned from; of
    languages at one margin the first in order is taken; other columns are ignored; an empty table gives no rows. Long
    texts count whole."""
    spark = docs.sparkSession
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang"))
    out = held_out("doc_id", 4, 2)
    usable = base.filter(~out & F.col("lang").isNotNull() & F.coalesce(F.regexp_like("text", F.lit(_HAS_LETTER)), F.lit(False)))
    sample = written(one_text_each(_sampled(usable, train_rows)), "sample")
    chosen = sample.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(LANDMARKS).select("doc_id", "text")  # of any language
    marks = chosen.mapInArrow(_marks, "doc_id long, grams binary").toPandas().sort_values("doc_id")
    found = [np.frombuffer(bytes(g), np.int32) for g in marks["grams"]]
    landmarks = Landmarks(found)
    rows = sample.mapInArrow(_kernels(spark.sparkContext.broadcast(landmarks)), "doc_id long, lang string, kernels binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(map(bytes, rows["kernels"])), np.float32).reshape(len(rows), len(found)).astype(float)
    discard(sample)
    names, coefficients = fit(np.array([landmarks.kernel(f) for f in found]).reshape(len(found), len(found)), x, rows["lang"].tolist())
    model = spark.sparkContext.broadcast((names, landmarks.row, landmarks.folded(coefficients)))
    asked = base.select("doc_id", "text", F.coalesce(F.regexp_like("text", F.lit(_HAS_LETTER)), F.lit(False)).alias("letters"))
    scored = asked.mapInArrow(_scorer(model), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score")
