"""Toxicity by nearest labelled examples: exact cosine of TF-IDF vectors of whole texts through a block-max inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER_ASCII, chunks, text_bytes, word_codes
from .labelled import held_out, one_text_each, training_sample
from .quality import _LETTERS
from .scratch import discard, written

#: Labelled examples in the index, about: half of each label if there are so many.
EXAMPLES = 4_000
#: A neighbour's vote weighs 1 + TELLING times the mean correlation with the label of the words that make up its cosine,
#: counting those that are significant at one in a million (many words are tested). TELLING and EVEN were chosen once, by five folds of the
#: training rows. The vectors know nothing of the label.
CHI_SQUARED, TELLING = 23.93, 1000.0
NEIGHBOURS = 25
#: Examples whose greatest weights a block of postings knows.
BLOCK = 32
#: Weight of the share of label 1 among all examples in a vote.
PRIOR = 2.0
#: In calibration a label weighs by a mean of its share among all labelled rows (0) and one half (1).
EVEN = 0.75


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, hashes and counts of the distinct terms (runs of letters, A-Z lower-cased) of all texts, by text."""
    codes, bounds = word_codes(LOWER_ASCII[data], offsets, _LETTERS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    terms, which = np.unique(codes, return_inverse=True)
    pairs, counts = np.unique(doc * max(len(terms), 1) + which, return_counts=True)
    owner, term = np.divmod(pairs, max(len(terms), 1))
    return owner, terms[term] if len(terms) else np.zeros(0, np.uint64), counts


def _lists(owner: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=1 << 20):
        owner, terms, counts = term_counts(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), _lists(owner, batch.num_rows, terms.view(np.int64), pa.int64()), _lists(owner, batch.num_rows, counts, pa.int32())], names=["doc_id", "y", "terms", "counts"])


def _vectoriser(vocabulary):
    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = vocabulary.value, TaskContext.get().partitionId() << 40
        for batch in chunks(batches, limit=1 << 20):
            owner, words, counts = term_counts(*text_bytes(batch.column("text")))
            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            hit = known[at] == words if len(known) else np.zeros(len(words), bool)
            n = batch.num_rows
            some = np.bincount(owner, minlength=n) > 0
            inside = _lists(owner[hit], n, at[hit], pa.int32()), _lists(owner[hit], n, counts[hit], pa.int32())
            outside = _lists(owner[~hit], n, words[~hit].view(np.int64), pa.int64()), _lists(owner[~hit], n, counts[~hit], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), batch.column("doc_id"), *inside, *outside, pa.array(some)], names=["row", "doc_id", "terms", "counts", "others", "times", "words"])
            first += n

    return vectorise


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of examples. A block of a term's postings knows its greatest weight,
    so the sum over a query's terms bounds the cosine of every example of the block, before a posting is read.

    Examples are placed by their most common term and their number of terms: like languages and lengths stand together."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, common: np.ndarray, block: int = BLOCK):
        n = len(ids)
        size = np.bincount(owner, minlength=n)
        lead = np.full(n, -1, np.int64)  # the most common term of each example
        by = np.lexsort((terms, common[terms], owner))
        filled = np.flatnonzero(size)
        lead[filled] = terms[by][np.cumsum(size)[filled] - 1]
        order = np.lexsort((ids, size, lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.y, self.block, self.blocks = ids[order], y[order].astype(float), block, -(-n // block)
        rows = place[owner]
        by = np.lexsort((rows, terms))
        rows, terms = rows[by], terms[by]
        self.docs, self.weights = rows.astype(np.int32), weights[by].astype(np.float32)
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (terms[1:] != terms[:-1]) | (rows[1:] // block != rows[:-1] // block)
        first = np.flatnonzero(fresh)
        self.start = np.append(first, len(rows))
        self.of_block, self.term = (rows[first] // block).astype(np.int32), terms[first].astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else self.weights[:0]
        self.bounds = np.searchsorted(terms[first], np.arange(len(common) + 1))

    def _read(self, entries: np.ndarray, factor: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, int]:
        """Sums over the postings of the wanted entries, by example, and how many these are."""
        e = entries[wanted]
        fresh = np.ones(len(e), bool)  # neighbours in one term's postings are read in one stretch
        fresh[1:] = (np.diff(e) != 1) | (np.diff(self.term[e]) != 0)
        first = np.flatnonzero(fresh)
        a, b = self.start[e[first]], self.start[e[np.append(first[1:] - 1, len(e) - 1)] + 1] if len(e) else self.start[:0]
        p = _ranges(a, b)
        return np.bincount(self.docs[p], self.weights[p] * np.repeat(factor[wanted][first], b - a), minlength=len(self.ids)), len(p)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """The k examples of the greatest cosine over 0 (ties: the lower place), the cosines, and which share of the
        terms' postings was read. `skip`: an id left out.

        The blocks of the greatest bounds are read first; then those whose bound isn't less than the k-th cosine found."""
        lo, hi = self.bounds[terms], self.bounds[terms + 1]
        entries = _ranges(lo, hi)
        if not len(entries):
            return np.zeros(0, np.int64), np.zeros(0), 0.0
        factor, block = np.repeat(weights, hi - lo), self.of_block[entries]
        bound = np.bincount(block, self.most[entries] * factor, minlength=self.blocks) + 1e-6  # weights are rounded
        order = np.argsort(-bound, kind="stable")[: max(4, 2 * k // self.block)]
        chosen = np.zeros(self.blocks, bool)
        chosen[order] = True
        own = np.flatnonzero(self.ids == skip) if skip is not None else np.zeros(0, np.int64)
        scores, read = self._read(entries, factor, chosen[block])
        scores[own] = 0.0
        cut = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        more, n = self._read(entries, factor, (bound >= max(cut, 2e-6))[block] & ~chosen[block])
        scores, read = scores + more, read + n
        scores[own] = 0.0
        found = np.flatnonzero(scores > 1e-9)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
        found = found[np.lexsort((found, -scores[found]))][:k]
        return found, scores[found], read / max(1, int((self.start[hi] - self.start[lo]).sum()))


    def telling(self, terms: np.ndarray, weights: np.ndarray, found: np.ndarray, cosine: np.ndarray, tells: np.ndarray) -> np.ndarray:
        """For each found example the mean of `tells` over the words that make up its cosine, weighted by their part of it."""
        some = tells[terms] > 0
        terms, factor = terms[some], (weights * tells[terms])[some]
        lo, hi = self.start[self.bounds[terms]], self.start[self.bounds[terms + 1]]
        p = _ranges(lo, hi)
        return np.bincount(self.docs[p], self.weights[p] * np.repeat(factor, hi - lo), minlength=len(self.ids))[found] / cosine


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each lo up to its hi."""
    many = hi - lo
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - many), many)


class Scale:
    """Turns the labels and cosines of neighbours into a calibrated score. It holds a few numbers only."""

    def __init__(self, y: np.ndarray, bare: np.ndarray):
        self.prior = float((y.sum() + 1.0) / (len(y) + 2.0))
        self.bare = float((y[bare].sum() + PRIOR * self.prior) / (bare.sum() + PRIOR))
        self.slope, self.shift = 1.0, 0.0

    @staticmethod
    def _logit(p: float) -> float:
        return math.log(p / (1 - p))

    def calibrate(self, votes: np.ndarray, y: np.ndarray, share: float) -> None:
        """Logistic regression of the labels on the examples' own votes, each without itself. `share`: of label 1 among
        all labelled rows; the sample has another."""
        if len(set(y.tolist())) < 2:
            return
        x, y, a, b = np.log(votes / (1 - votes)), y.astype(float), 1.0, 0.0
        target = share + EVEN * (0.5 - share)
        each = np.where(y > 0, target / y.mean(), (1 - target) / (1 - y.mean()))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = each * p * (1 - p) + 1e-6
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([(each * (p - y) * x).sum(), (each * (p - y)).sum()]))
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-8:
                break
        if a > 0:
            self.slope, self.shift = float(a), float(b)

    def vote(self, labels: np.ndarray, cosine: np.ndarray, tells: np.ndarray) -> float:
        """The weighted share of label 1 among the nearest, before calibration. An example at distance d = 1 - cosine
        has the weight (1 + TELLING * tells) / (d + 0.05); the share of all examples has the weight PRIOR."""
        weight = (1.0 + TELLING * tells) / (1.05 - np.minimum(cosine, 1.0))
        return float((weight @ labels + PRIOR * self.prior) / (weight.sum() + PRIOR))

    def score(self, labels: np.ndarray, cosine: np.ndarray, tells: np.ndarray, words: bool) -> float:
        if not len(labels):
            return self.prior if words else self.bare
        return 1 / (1 + math.exp(-(self.slope * self._logit(self.vote(labels, cosine, tells)) + self.shift)))


def raw_weights(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (1 + np.log(np.maximum(counts, 1))) * weights[terms]


def association(known: int, y: np.ndarray, owner: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The size of each known term's correlation with the label over the examples; 0 where it isn't significant."""
    n, ones = len(y), float(y.sum())
    df = np.bincount(terms, minlength=known).astype(float)
    both = np.bincount(terms, y[owner].astype(float), minlength=known)
    spread = df * (n - df) * ones * (n - ones)
    square = np.where(spread > 0, (n * both - ones * df) ** 2 / np.maximum(spread, 1), 0.0)
    return np.sqrt(np.where(n * square >= CHI_SQUARED, square, 0.0))


EVIDENCE = "array<struct<doc_id:long,label:int,cosine:double>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))


def _neighbours(batch: pa.RecordBatch, model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each text its nearest examples, their cosines with its known words alone, what these tell, and the square of
    the length of the known words: a text's own length changes no order."""
    index, weights, tells, _ = model.value
    terms, counts = batch.column("terms"), batch.column("counts")
    bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
    flat = terms.flatten().to_numpy().astype(np.int64)
    raw = raw_weights(flat, counts.flatten().to_numpy(), weights)
    for i, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
        square = float(raw[a:b] @ raw[a:b])
        unit = raw[a:b] / math.sqrt(square) if square else raw[a:b]
        found, cosine, _ = index.nearest(flat[a:b], unit, NEIGHBOURS, i)
        yield found, cosine, index.telling(flat[a:b], unit, found, cosine, tells), square


def _own_votes(model):
    """The vote on each example, without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, _, scale = model.value
        for batch in batches:
            votes = [scale.vote(index.y[found], cosine, tells) if len(found) else None for found, cosine, tells, _ in _neighbours(batch, model)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(votes, pa.float64())], names=["y", "vote"])

    return run


_FOUND = "row long, doc_id long, words boolean, square double, found array<int>, cosine array<float>, tells array<float>"


def _finder(model):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cosine, tells, square = zip(*_neighbours(batch, model), strict=True) if batch.num_rows else ((), (), (), ())
            lists = [pa.array(x, pa.list_(t)) for x, t in ((found, pa.int32()), (cosine, pa.float32()), (tells, pa.float32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "words")], pa.array(square, pa.float64()), *lists], names=["row", "doc_id", "words", "square", "found", "cosine", "tells"])

    return find


def _voter(model, scale: Scale):
    """Scores and evidence from neighbours, once the length of the whole text is known (`square` and `rest`)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value[0]
        for batch in batches:
            scores, evidence = [], []
            known, rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("square", "rest"))
            part = np.sqrt(known / np.maximum(known + rest, 1e-30))
            for found, cosine, tells, words, share in zip(*(batch.column(c) for c in ("found", "cosine", "tells", "words")), part, strict=True):
                at, cos = found.values.to_numpy(), cosine.values.to_numpy().astype(float) * share
                scores.append(scale.score(index.y[at], cos, tells.values.to_numpy().astype(float), words.as_py()))
                evidence.append([{"doc_id": int(index.ids[x]), "label": int(index.y[x]), "cosine": float(c)} for x, c in zip(at[:3], cos[:3], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, _EVIDENCE)], names=["doc_id", "score", "evidence"])

    return score


def _rest(vectors: DataFrame, total: int) -> DataFrame:
    """Rows (row, rest): the square of the length of a text's words that no example has. Their document frequencies are
    counted over all texts and joined back by word; a word of one text only needs no join."""
    def square(df: Column) -> Column:
        return F.pow((1 + F.log("n")) * (F.log((1 + F.lit(total)) / (1 + df)) + 1), 2)

    words = vectors.select("row", F.explode(F.arrays_zip("others", "times")).alias("w")).select("row", F.col("w.others").alias("word"), F.col("w.times").alias("n"))
    common = words.groupBy("word").agg(F.count("*").alias("df")).filter("df > 1")
    less = words.join(common, "word").groupBy("row").agg(F.sum(square(F.lit(1)) - square(F.col("df"))).alias("less"))
    once = F.aggregate("times", F.lit(0.0), lambda acc, n: acc + F.pow((1 + F.log(n.cast("double"))) * (F.log(F.lit((1 + total) / 2)) + 1), 2))
    most = vectors.filter(F.size("others") > 0).select("row", once.alias("most"))
    return most.join(less, "row", "left").select("row", F.greatest(F.col("most") - F.coalesce("less", F.lit(0.0)), F.lit(0.0)).alias("rest"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = 0.5, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, evidence): calibrated votes of the nearest labelled examples.

    About `examples` labelled rows, none held out and half of each label if there are so many, are indexed with all of
    their words. A word has the weight (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), with n and df over all documents; the
    cosine is that of whole texts, words that no example has included. The label plays a part in the vote alone (TELLING).
    Evidence is the nearest three examples. An example's own row never votes for itself.

    Defined results: null and empty texts, and texts without words, score the smoothed share of label 1 among examples
    without words; texts that share no word with any example, that of all examples; a null id is held out and scored;
    repeated ids are scored each, and the least of their texts is learned from; without usable labels the score is 0.5;
    other columns are ignored; an empty table gives no rows. Of examples at one cosine the one of the lower place in the
    index is nearer. Long texts count whole."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample, share = training_sample(labels, target, examples, by_label=True)
    chosen = one_text_each(base.join(F.broadcast(sample), "doc_id"))  # bounded by `examples`
    told = written(chosen.mapInArrow(_example_terms, "doc_id long, y int, terms array<long>, counts array<int>"), "examples")
    table = told.orderBy("doc_id").toArrow().combine_chunks()  # bounded by `examples`
    ids, y = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "y"))
    words, counts, sizes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    if table.num_rows:
        lists = table.column("terms").combine_chunks()
        words, counts, sizes = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy(), lists.value_lengths().to_numpy()
    known, at = np.unique(words.view(np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), sizes)
    vocabulary = spark.sparkContext.broadcast(known)
    schema = "row long, doc_id long, terms array<int>, counts array<int>, others array<long>, times array<int>, words boolean"
    vectors = written(base.mapInArrow(_vectoriser(vocabulary), schema), "vectors")
    total, df = vectors.count(), np.zeros(len(known))
    seen = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[seen["term"].to_numpy()] = seen["count"].to_numpy()
    weights = np.log((1 + total) / (1 + df)) + 1
    raw = raw_weights(at, counts, weights)
    length = np.sqrt(np.bincount(owner, raw * raw, minlength=len(ids)))
    index = BlockMaxIndex(ids, y, owner, at, raw / length[owner] if len(raw) else raw, df)
    scale = Scale(y, sizes == 0)
    model = spark.sparkContext.broadcast((index, weights, association(len(known), y, owner, at), scale))
    own = told.select("y", "doc_id", "terms", "counts").mapInArrow(_known(vocabulary), "doc_id long, y int, terms array<int>, counts array<int>")
    votes = own.mapInArrow(_own_votes(model), "y int, vote double").filter("vote is not null").toPandas()  # bounded by `examples`
    votes = votes.sort_values(["y", "vote"])
    discard(told)
    scale.calibrate(votes["vote"].to_numpy(float), votes["y"].to_numpy(), share)
    found = vectors.select("row", "doc_id", "terms", "counts", "words").mapInArrow(_finder(model), _FOUND)
    known_rest = found.join(_rest(vectors, total), "row", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    scored = known_rest.mapInArrow(_voter(model, scale), f"doc_id long, score double, evidence {EVIDENCE}")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def _known(vocabulary):
    """Examples with their terms as places in the vocabulary, which has all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            at = np.searchsorted(vocabulary.value, lists.flatten().to_numpy().view(np.uint64))
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), _lists(owner, batch.num_rows, at, pa.int32()), batch.column("counts")], names=["doc_id", "y", "terms", "counts"])

    return run
