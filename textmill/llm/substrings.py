"""Removal of long repeated strings by bucket-pointer refinement.

Strings are runs of units: bytes of a text, or its words. A start stands for the `length` units from it on. Starts are
kept in runs, so that whole passages move as one row:

1. Each start has an anchor, the place of the least hashed q-gram in its string, the first of equals. Like strings have
   like anchors at like offsets. Starts next to each other with one anchor are a run; its first bucket is its q-gram.
2. A round sorts runs by (bucket, whole content). Buckets of one run alone are done: nothing in them repeats. Contents
   that stand in two places repeat as a whole and are done, too. What is left is cut into narrower runs by offset from
   the anchor, and each gets a new bucket identifier: made of the identifier that its run had before and those of the
   strings at the earlier and later offsets that all starts of the narrower run cover besides.
3. Rounds recur on what the round before left open, with its identifiers, until runs are single starts: then the
   bucket identifier stands for the whole string.

Identifiers are hashes of 64 bits, of contents 128 bits more, so no numbering needs all rows in one place. Buckets are
counts: none is ever gathered, however many texts share a passage, and copies of a content are one row before the shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODES, GOLDEN, NOT_SPACE, chunks, hash_spans, mix64, prefix_codes, text_bytes, word_codes
from .scratch import discard, release, written

_LEAST = -(2**63)
_OTHER = np.uint64(0x9D39247E33776D41)


class Units(NamedTuple):
    """What strings are made of: `length` units a string, q-grams of `gram` units; words or bytes; and whether a string
    must stand in another document to count (`across`) or just anywhere else."""

    length: int
    gram: int
    words: bool = False
    across: bool = False

    def widths(self) -> list[int]:
        """How many offsets a run spans in each round after the first; each divides the one before."""
        step = max(1, round((self.length - self.gram + 1) ** (1 / 3)))
        return list(dict.fromkeys([step * step, step, 1]))

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A code for each unit of all texts, and where each text begins."""
        data, offsets = text_bytes(column)
        return word_codes(data, offsets, NOT_SPACE) if self.words else (BYTE_CODES[data], offsets)


def bytes_units(length: int) -> Units:
    return Units(length, max(1, min(64, length // 2)))


def word_units(length: int) -> Units:
    return Units(length, max(1, min(4, length // 2)), words=True, across=True)


class Spans:
    """Identifiers of spans of an array of codes."""

    def __init__(self, codes: np.ndarray):
        self.first, self.second = prefix_codes(codes), prefix_codes(mix64(codes ^ _OTHER))

    def bucket(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return hash_spans(self.first, lo, hi)

    def content(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of a span together with a place in it."""
        return tuple(mix64(hash_spans(p, lo, hi) + place.astype(np.uint64) * GOLDEN).view(np.int64) for p in (self.first, self.second))


def anchors(codes: np.ndarray, offsets: np.ndarray, units: Units) -> dict[str, np.ndarray]:
    """Runs of all starts inside one text each: text number, q-gram bucket k, content (u, v), anchor a, and the first and
    last start lo and hi, counted from the start of the text."""
    n, length, gram = len(codes), units.length, units.gram
    width = length - gram + 1
    names = ("doc", "k", "u", "v", "a", "lo", "hi")
    if n < length:
        return {c: np.zeros(0, np.int64) for c in names}
    spans = Spans(codes)
    at = np.arange(n - gram + 1)
    bucket = spans.bucket(at, at + gram)
    ranked = (bucket & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)  # high bits decide, then the first place
    padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(ranked)] = ranked
    block = padded.reshape(-1, width)
    before = np.minimum.accumulate(block, axis=1).reshape(-1)
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    least = np.minimum(after[:starts], before[width - 1 : width - 1 + starts])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    s = np.flatnonzero(doc[:starts] == doc[length - 1 :])
    if not len(s):
        return {c: np.zeros(0, np.int64) for c in names}
    a = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = doc[s]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])]))
    lo, hi, a = s[first], s[np.append(first[1:] - 1, len(s) - 1)], a[first]
    u, v = spans.content(lo, hi + length, a - lo)
    base = offsets[owner[first]]
    return {"doc": owner[first], "k": bucket[a].view(np.int64), "u": u, "v": v, "a": a - base, "lo": lo - base, "hi": hi - base}


_RUN = "r long, id long, copy long, k long, u long, v long, a int, lo int, hi int"


def _numbers(start: int, n: int) -> pa.Array:
    """Numbers of a task's next rows; no other task has them."""
    return pa.array(np.arange(n) + (start + (TaskContext.get().partitionId() << 40)))


def _runs(units: Units):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in chunks(batches, limit=1 << 19):  # some fifteen arrays of 8 bytes for each byte of text
            got = anchors(*units.codes(batch.column("text")), units)
            take = pa.array(got["doc"])
            yield pa.RecordBatch.from_arrays([_numbers(n, len(take)), batch.column("id").take(take), batch.column("copy").take(take), *[pa.array(got[c]) for c in ("k", "u", "v")], *[pa.array(got[c], pa.int32()) for c in ("a", "lo", "hi")]], names=["r", "id", "copy", "k", "u", "v", "a", "lo", "hi"])
            n += len(take)

    return find


def sort_round(runs: DataFrame, units: Units, name: str) -> DataFrame:
    """One round on runs (r, id, copy, k, u, v, lo, hi, ...), written: those in live buckets, with `whole` if their content
    repeats as a whole and `open` if they are to be cut.

    A bucket is live if more than one run is in it (from more than one document, where that is asked). Open are, of live
    buckets that hold a content which doesn't repeat as a whole, such contents and one run of each content that does."""
    doc = F.xxhash64("id", "copy")
    counts = [F.min(doc).alias("d0"), F.max(doc).alias("d1")] if units.across else [F.count("*").alias("c")]
    contents = runs.groupBy("k", "u", "v").agg(F.min("r").alias("first"), *counts)
    contents = contents.withColumn("whole", F.expr("d0 <> d1" if units.across else "c > 1"))
    settled = F.min("whole").alias("settled")
    if units.across:
        buckets = contents.groupBy("k").agg(settled, F.min("d0").alias("e0"), F.max("d1").alias("e1")).filter("e0 <> e1")
    else:
        buckets = contents.groupBy("k").agg(settled, F.sum("c").alias("n")).filter("n > 1")
    live = written(contents.join(buckets.select("k", "settled"), "k").select("k", "u", "v", "whole", "settled", "first"), f"{name}-buckets")
    is_open = F.expr("not settled and (not whole or r = first)").alias("open")
    placed = written(runs.join(live, ["k", "u", "v"]).select(*[c for c in runs.columns if c not in ("r", "u", "v")], "whole", is_open), name)
    discard(live)
    return placed


_CONTEXT = "id long, copy long, at int, a int, k long, lo int, hi int, context binary"


def _contexts(units: Units):
    """The units that a run's strings cover: bytes as they are, words by their codes of 8 bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["id", "copy", "at", "a", "k", "lo", "hi", "context"]
        for batch in chunks(batches, limit=1 << 20):
            rows: list[tuple] = []
            if units.words:
                codes, offsets = units.codes(batch.column("text"))
                raws = [codes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            else:
                raws = [t.encode() for t in batch.column("text").to_pylist()]
            size = 8 if units.words else 1
            for key, copy, raw, runs in zip(batch.column("id").to_pylist(), batch.column("copy").to_pylist(), raws, batch.column("runs").to_pylist(), strict=True):
                rows += [(key, copy, x["lo"], x["a"], x["k"], x["lo"], x["hi"], raw[size * x["lo"] : size * (x["hi"] + units.length)]) for x in runs]
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5000], strict=True), types, strict=True)], names=names)

    return cut


def narrower(spans: Spans, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, units: Units, width: int, before: int | None) -> dict[str, np.ndarray]:
    """Runs cut by offset from the anchor into runs of `width` offsets (`before`: the width they had; None: the first
    runs, whose bucket is the q-gram at a). Places are those in the codes of `spans`. row tells which run each is of.

    The strings of a run of offsets x..y share the units from a - x on, `length` - (y - x) of them. A narrower run shares
    more, to both sides: its bucket identifier is made of the identifier before and those of the two strings added."""
    deepest = units.length - units.gram
    first, last = (a - hi) // width, (a - lo) // width
    many = last - first + 1
    row = np.repeat(np.arange(len(a)), many)
    j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    anchor = a[row]

    def core(j: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return anchor - j * width, anchor - np.minimum((j + 1) * width - 1, deepest) + units.length

    start, end = core(j, width)
    old_start, old_end = (anchor, anchor + units.gram) if before is None else core(j * width // before, before)
    bucket = mix64(k[row].view(np.uint64) ^ mix64(spans.bucket(old_end, end) + j.astype(np.uint64) * GOLDEN))
    bucket = mix64(bucket + spans.bucket(start, old_start) * GOLDEN)
    part_lo, part_hi = np.maximum(lo[row], anchor - (j + 1) * width + 1), np.minimum(hi[row], anchor - j * width)
    u, v = spans.content(part_lo, part_hi + units.length, anchor - part_lo)
    return {"row": row, "k": bucket.view(np.int64), "u": u, "v": v, "lo": part_lo, "hi": part_hi}


def _cutter(units: Units, width: int, before: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in chunks(batches, "context", 1 << 20):
            data, offsets = text_bytes(batch.column("context"))
            codes, offsets = (data.view(np.uint64), offsets // 8) if units.words else (BYTE_CODES[data], offsets)
            runs = batch.column("runs")
            of = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
            flat = runs.flatten()
            k, lo, hi = (flat.field(c).to_numpy().astype(np.int64) for c in ("k", "lo", "hi"))
            at, a = (batch.column(c).to_numpy().astype(np.int64)[of] for c in ("at", "a"))
            shift = offsets[of] - at
            got = narrower(Spans(codes), a + shift, lo + shift, hi + shift, k, units, width, before)
            row, back = got["row"], shift[got["row"]]
            take = pa.array(of[row])
            yield pa.RecordBatch.from_arrays([_numbers(n, len(take))] + [batch.column(c).take(take) for c in ("id", "copy", "at")] + [pa.array(got[c]) for c in ("k", "u", "v")] + [pa.array(got[c] - back, pa.int32()) for c in ("lo", "hi")], names=["r", "id", "copy", "at", "k", "u", "v", "lo", "hi"])
            n += len(take)

    return cut


def repeated_spans(docs: DataFrame, units: Units, rounds: list | None = None) -> DataFrame:
    """Rows (id, copy, spans) for documents (id, copy, text): starts lo..hi of strings that also start elsewhere.

    `rounds` (for tests) gets the collected runs in live buckets of each round."""
    spark = docs.sparkSession

    done, tables = [], []

    def refined(runs: DataFrame, name: str) -> DataFrame:
        placed = sort_round(runs, units, name)
        if rounds is not None:
            rounds.append([(x.k, x.whole, x.open, x.lo, x.hi) for x in placed.collect()])
        done.append(placed.filter("whole").select("id", "copy", "lo", "hi"))
        tables.append(placed)
        discard(runs)
        release(spark)
        return placed.filter("open")

    left = refined(written(docs.mapInArrow(_runs(units), _RUN), "runs"), "grams")
    # rows alike in id and text have the same runs: sets, so that their number doesn't multiply
    asked = left.groupBy("id", "copy").agg(F.collect_set(F.struct("k", "a", "lo", "hi")).alias("runs"))
    texts = docs.join(asked, ["id", "copy"]).select("id", "copy", "text", "runs")
    contexts = written(texts.mapInArrow(_contexts(units), _CONTEXT).dropDuplicates(["id", "copy", "at"]), "contexts")
    release(spark)
    chosen = contexts.withColumn("runs", F.array(F.struct("k", "lo", "hi")))
    before = None
    for width in units.widths():
        schema = "r long, id long, copy long, at int, k long, u long, v long, lo int, hi int"
        parts = written(chosen.select("id", "copy", "at", "a", "context", "runs").mapInArrow(_cutter(units, width, before), schema), "parts")
        left = refined(parts, "buckets")
        again = left.groupBy("id", "copy", "at").agg(F.collect_set(F.struct("k", "lo", "hi")).alias("runs"))
        chosen = contexts.select("id", "copy", "at", "a", "context").join(again, ["id", "copy", "at"])
        before = width
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    spans = written(every.groupBy("id", "copy").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    for table in (contexts, *tables):
        discard(table)
    release(spark)
    return spans


def _covered(spans: pa.Scalar, size: int, length: int) -> np.ndarray:
    """Which of `size` units the strings from lo to hi cover."""
    lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + length, -1)
    return np.cumsum(step[:-1]) > 0


def _remover(length: int, passage: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for key, text, spans, passages in zip(*(batch.column(c) for c in ("doc_id", "text", "spans", "passages")), strict=True):
                raw = text.as_py().encode()
                kept, covered, runs, words = raw, 0, [], 0
                if spans.is_valid and len(spans.values):
                    gone = _covered(spans, len(raw), length)
                    runs = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                    covered = int(gone.sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                if passages.is_valid and len(passages.values):
                    words = int(_covered(passages, int(passages.values.field("hi").to_numpy().max()) + passage, passage).sum())
                rows.append((key, len(raw), covered, len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in runs], words))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed", "n_passage_words"])

    return remove


def remove_repeats(docs: DataFrame, length: int = 400, passage_words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, removed, n_passage_words): texts as UTF-8 without
    repeated strings.

    Each byte goes that lies in a string of `length` bytes which also starts anywhere else, in another text or the same
    one, overlaps included; strings are judged on the input. kept has the remaining bytes joined (cuts may fall inside
    a character), removed the maximal removed runs. n_passage_words counts, and removes nothing, the words (separated by
    blanks) that lie in a run of `passage_words` words which also stands in another document.

    Defined results: null and empty texts have no bytes; texts shorter than `length` are kept whole; rows alike in id
    and text are different documents to the byte strings, so both go if long enough, and one document to the passages;
    a null id stays null; other columns are ignored; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    rows = base.select("id", "copy", "text")
    spans = repeated_spans(rows, bytes_units(length))
    passages = repeated_spans(rows, word_units(passage_words)).withColumnRenamed("spans", "passages")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>, n_passage_words long"
    joined = base.join(spans, ["id", "copy"], "left").join(passages, ["id", "copy"], "left")
    return joined.select("doc_id", "text", "spans", "passages").mapInArrow(_remover(length, passage_words), schema)
