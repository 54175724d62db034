"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import GOLDEN, chunks, hash_spans, mix64, prefix_hash, text_bytes, word_spans
from .labelled import WIDE, bounded, held_out, temperature, training_sample
from .scratch import written

#: Words share 2**WORD_BITS context vectors by their hash, so what is summed and sent out has a fixed size.
WORD_BITS = 14
DIMENSIONS = 64
#: Neighbours on each side that count as context.
WINDOW = 2
#: Text that a task works on at a time: its words have vectors of DIMENSIONS numbers, several times over.
TEXT_BYTES = 1 << 17
#: Labelled rows learned from, about.
TRAIN_ROWS = 20_000
HIDDEN = 48

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[ord("0") : ord("9") + 1] = True
_SYMBOLS = ~_LETTERS & ~_DIGITS
_SYMBOLS[[0x20, *range(0x09, 0x0E)]] = False


def index_vectors() -> np.ndarray:
    """A sparse ternary random vector for each word slot: about an eighth of its entries are +1 or -1."""
    cells = mix64(np.arange(1, (DIMENSIONS << WORD_BITS) + 1, dtype=np.uint64) * GOLDEN)
    return (np.where(cells & np.uint64(8), 1, -1) * ((cells & np.uint64(7)) == 0)).astype(np.int8).reshape(-1, DIMENSIONS)


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of all texts in order (runs of letters, of digits, of other signs), and where each text begins."""
    spans = [word_spans(data, offsets, table)[:2] for table in (_LETTERS, _DIGITS, _SYMBOLS)]
    starts = np.concatenate([s for s, _ in spans])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([e for _, e in spans])[order]
    slots = (hash_spans(prefix_hash(data), starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    return slots, np.searchsorted(starts, offsets)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors of each word's neighbours over all texts of a task."""
    index, total = index_vectors(), np.zeros((1 << WORD_BITS, DIMENSIONS), dtype=np.int64)
    seen = np.zeros(1 << WORD_BITS, dtype=np.int64)
    for batch in chunks(batches, limit=TEXT_BYTES):
        slots, bounds = word_slots(*text_bytes(batch.column("text")))
        if not len(slots):
            continue
        own = index[slots].astype(np.int16)
        text = np.searchsorted(bounds, np.arange(len(slots)), "right")
        around = np.zeros_like(own)
        for k in range(1, WINDOW + 1):
            same = (text[k:] == text[:-k])[:, None]
            around[k:] += own[:-k] * same
            around[:-k] += own[k:] * same
        order = np.argsort(slots, kind="stable")
        groups, first = np.unique(slots[order], return_index=True)
        total[groups] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
        seen[groups] += np.diff(np.append(first, len(slots)))
    used = np.flatnonzero(seen)
    vectors = [v.tobytes() for v in total[used].astype("<i4" if abs(total).max(initial=0) < 2**31 else "<i8")]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64()), pa.array(vectors, pa.binary())], names=["slot", "n", "vector"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slot; a task holds at most all slots."""
    total: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for slot, n, raw in zip(*(batch.column(c).to_pylist() for c in ("slot", "n", "vector")), strict=True):
            vector = np.frombuffer(raw, "<i4" if len(raw) == 4 * DIMENSIONS else "<i8").astype(np.int64)
            total[slot] = total[slot] + vector if slot in total else vector
            seen[slot] = seen.get(slot, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([seen[s] for s in total], pa.int64()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["slot", "n", "vector"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The unit context vector of each word slot, from all texts. Its size is fixed: 2**WORD_BITS by DIMENSIONS."""
    schema = "slot int, n long, vector binary"
    # partial sums, at most one row a slot and task, meet by slot; the tasks of the second step hold a share of the slots each
    sums = texts.select("text").mapInArrow(_context, schema).repartition("slot").mapInArrow(_summed, schema).toPandas()
    table, seen = np.zeros((1 << WORD_BITS, DIMENSIONS)), np.zeros(1 << WORD_BITS)
    for slot, n, raw in zip(sums["slot"], sums["n"], sums["vector"], strict=True):
        table[slot], seen[slot] = np.frombuffer(raw, "<i8"), n
    if seen.sum():
        table -= np.outer(seen, table.sum(axis=0) / seen.sum())  # what any word would have by its frequency
    norm = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def _pooler(vectors):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vectors.value
        square = table * table
        for batch in chunks(batches, limit=TEXT_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            slots, bounds = word_slots(data, offsets)
            out = np.zeros((batch.num_rows, 2 * DIMENSIONS + 4), dtype=np.float32)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            if len(full):
                out[full, :DIMENSIONS] = np.add.reduceat(table[slots], bounds[full], axis=0) / n[full, None]
                out[full, DIMENSIONS:-4] = np.sqrt(np.add.reduceat(square[slots], bounds[full], axis=0) / n[full, None])
                # how much a text repeats its own words
                order = np.lexsort((slots, owner := np.repeat(np.arange(batch.num_rows), n)))
                fresh = np.ones(len(slots), dtype=bool)
                fresh[1:] = (slots[order][1:] != slots[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                out[full, -4] = (np.add.reduceat(fresh, bounds[full], dtype=np.int64) / n[full]).astype(np.float32)
            out[:, -3] = np.log1p(n)
            out[:, -2] = np.log1p(np.diff(offsets))
            out[:, -1] = np.sqrt((out[:, :DIMENSIONS] ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array([r.tobytes() for r in out], pa.binary())], names=["doc_id", "text_md5", "features"])

    return pool


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60) -> dict[str, np.ndarray | float]:
    """A network of one hidden layer (tanh) by Adam. A sixth of the rows is used for nothing but the temperature. Another
    sixth tells after how many epochs to stop; then the network is fitted anew for so many on these rows, too.

    The m rows of the temperature also bound scores: m rows without an error speak for (m + 1) / (m + 2) at most. With
    no rows, or rows of one class only, it scores that class's smoothed share."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    width = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if len(x) else (np.zeros(width), np.ones(width))
    model = {"mean": mean, "scale": scale, "w1": np.zeros((width, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.array(np.log(share / (1 - share))), "temperature": 1.0, "bound": WIDE}
    if len(np.unique(y)) < 2:
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    order = rng.permutation(len(y))
    sixth = max(1, len(y) // 6)
    back, last, train = order[:sixth], order[sixth : 2 * sixth], order[2 * sixth :]
    if not len(train):
        return model

    def logits(p: dict, rows: np.ndarray) -> np.ndarray:
        return np.tanh(z[rows] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]

    losses = [np.mean(np.logaddexp(0, np.where(y[back] > 0, -t, t))) for t in (logits(p, back) for p in _epochs(z, y, train, model["b2"], seed, epochs))]
    *_, best = _epochs(z, y, np.concatenate([train, back]), model["b2"], seed, int(np.argmin(losses)) + 1)
    bound = float(np.log(len(last) + 1))
    return model | best | {"temperature": temperature(logits(best, last), y[last], bound), "bound": bound}


def _epochs(z: np.ndarray, y: np.ndarray, train: np.ndarray, start: np.ndarray, seed: int, epochs: int) -> Iterator[dict[str, np.ndarray]]:
    """The network's weights after each epoch over the rows `train`."""
    rng, width = np.random.default_rng(seed + 1), z.shape[1]
    p = {"w1": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": start.copy()}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[rows]) / len(rows)
            back_h = np.outer(d, p["w2"]) * (1 - h * h)
            grad = {"w1": z[rows].T @ back_h + 1e-4 * p["w1"], "b1": back_h.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum()}
            step += 1
            fresh = {}
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                fresh[k] = p[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            p = fresh
        yield p


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    logit = np.tanh(z @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]
    return 1 / (1 + np.exp(-bounded(logit / model["temperature"], model["bound"])))


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(probability(model.value, x), pa.float64())], names=["doc_id", "text_md5", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, text_md5): the calibrated probability of label 1, for every document.

    Word vectors are sums of the sparse random index vectors of neighbours, over all documents; a document is pooled to
    the mean and the root mean square of its words' unit vectors, with its length and share of fresh words. About
    `train_rows` labelled rows, none held out, train the network; a sixth of them, used for nothing else, sets its temperature.

    Defined results: null and empty texts have zero features and get the score of these; a null id is held out and
    scored; repeated ids are scored each, and the least of their features are learned from; labels of ids that don't occur are ignored; without usable labels the score is
    0.5; other columns are ignored; an empty table gives no rows."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    context = base.sparkSession.sparkContext.broadcast(word_vectors(base))
    pooled = written(base.withColumn("text_md5", F.md5("text")).mapInArrow(_pooler(context), "doc_id long, text_md5 string, features binary"), "pooled")
    sample, _ = training_sample(labels, target, train_rows)
    rows = pooled.join(sample, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("features").alias("features")).toPandas()  # bounded by `train_rows`
    rows["features"] = rows["features"].map(bytes)
    rows = rows.sort_values("doc_id")
    x = np.frombuffer(b"".join(rows["features"]), np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 2 * DIMENSIONS + 4))
    model = base.sparkSession.sparkContext.broadcast(fit(x.astype(float), rows["y"].to_numpy(float)))
    scored = pooled.mapInArrow(_scorer(model), "doc_id long, text_md5 string, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_md5")
