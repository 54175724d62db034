"""Matching a dictionary of any size: grams of texts meet each term's rarest gram, then whole terms are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of a gram at most: it fits a whole number, so grams are compared, not hashes of them.
GRAM = 8
#: Grams of texts are counted in 2**SLOT_BITS places by their hash, to find rare ones.
SLOT_BITS = 18
#: Bits of the filter of anchors that every task gets: 8 MB, however large the dictionary is.
FILTER_BITS = 26

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values as one array of bytes, followed by GRAM zeros, and where each begins."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(GRAM, np.uint8)]), offsets - offsets[0]


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each byte on, as whole numbers."""
    out = np.zeros(len(data) - GRAM, np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | data[k : k + len(out)]
    return out


def _mixed(grams: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    x = (grams ^ np.asarray(size, np.uint64)) * _MIX
    x ^= x >> np.uint64(29)
    return x * _MIX


def _pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes of text; a longer text alone."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` bytes end in the value they begin in."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(offsets[-1]) + size <= end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in _pieces(batches, "text"):
        data, offsets = _bytes(batch.column("text"))
        slots = _mixed(windows(data, GRAM)[_inside(offsets, GRAM)], GRAM) >> np.uint64(64 - SLOT_BITS)
        seen += np.bincount(slots.astype(np.int64), minlength=len(seen))
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["slot", "n"])


def _anchors(seen):
    """Each term with its rarest gram of GRAM bytes, or itself if it is shorter, and where that stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "term"):
            data, offsets = _bytes(batch.column("term"))
            sizes = np.diff(offsets)
            at, gram = offsets[:-1].copy(), np.zeros(len(sizes), np.uint64)
            for size in range(1, GRAM):
                gram[sizes == size] = windows(data, size)[at[sizes == size]]
            inside = np.flatnonzero(_inside(offsets, GRAM))
            grams = windows(data, GRAM)
            owner = np.searchsorted(offsets, inside, "right") - 1
            count = seen.value[(_mixed(grams[inside], GRAM) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            order = np.lexsort((inside, count, owner))
            owner, inside = owner[order], inside[order]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            at[owner[first]], gram[owner[first]] = inside[first], grams[inside[first]]
            size = np.minimum(sizes, GRAM)
            bit = (_mixed(gram, size) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(gram.view(np.int64)), pa.array(size, pa.int32()), pa.array(at - offsets[:-1]), pa.array(bit)], names=["term", "gram", "size", "at", "bit"])

    return run


def _found(anchored, sizes: list[int]):
    """Places of texts where a gram stands that may be an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = anchored.value
        for batch in _pieces(batches, "text"):
            data, offsets = _bytes(batch.column("text"))
            for size in sizes:
                grams = windows(data, size)
                bit = _mixed(grams, size) >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool) & _inside(offsets, size))
                row = np.searchsorted(offsets, hit, "right") - 1
                for k in range(0, len(hit), 50_000):
                    part = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([batch.column("copy").take(pa.array(row[part])), pa.array(grams[hit[part]].view(np.int64)), pa.array(np.full(len(hit[part]), size), pa.int32()), pa.array(hit[part] - offsets[row[part]])], names=["copy", "gram", "size", "place"])

    return run


def _word(char: Column) -> Column:
    """Whether the bytes are one ASCII letter, digit or underscore."""
    return F.regexp_like(F.decode(char, "ISO-8859-1"), F.lit("^[A-Za-z0-9_]$"))


def _by_text(base: DataFrame, terms: DataFrame, term_col: str, short: int) -> DataFrame:
    """Rows (copy, terms) of the texts (copy, text) with a term, each text once."""
    spark = base.sparkSession
    texts = written(base.groupBy("copy").agg(F.first("text").cast("binary").alias("text")), "texts")
    known = terms.select(F.col(term_col).cast("string").alias("term")).filter("term <> ''").distinct().select(F.col("term").cast("binary").alias("term"))
    counted = texts.select("text").mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2**SLOT_BITS rows
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    seen[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    anchors = written(known.mapInArrow(_anchors(spark.sparkContext.broadcast(seen)), "term binary, gram long, size int, at long, bit long"), "anchors")
    marks = anchors.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()  # 2**(FILTER_BITS - 6) rows
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[marks["word"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    sizes = sorted(r["size"] for r in anchors.select("size").distinct().collect())  # GRAM rows
    found = texts.mapInArrow(_found(spark.sparkContext.broadcast(bits), sizes), "copy binary, gram long, size int, place long")
    near = found.join(anchors, ["gram", "size"]).select("copy", "term", (F.col("place") - F.col("at")).cast("int").alias("start")).filter("start >= 0")
    both = near.join(texts, "copy")
    n = F.octet_length("term")
    same = F.substring("text", F.col("start") + 1, n) == F.col("term")
    start, end = F.col("start"), F.col("start") + n
    before, after = (start > 0) & _word(F.substring("text", start, F.lit(1))), (end < F.octet_length("text")) & _word(F.substring("text", end + 1, F.lit(1)))
    alone = (before != _word(F.substring("term", F.lit(1), F.lit(1)))) & (after != _word(F.substring("term", n, F.lit(1))))
    stands = (F.char_length(F.decode("term", "UTF-8")) > short) | alone
    # candidates lie by text already: no further shuffle
    return both.filter(same & stands).groupBy("copy").agg(F.collect_set(F.decode("term", "UTF-8")).alias("terms"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return rows.withColumn("copy", F.unhex(F.md5("text")))


def match_terms(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", term_col: str = "term", short: int = 0) -> DataFrame:
    """Rows (id, term): which terms of a table stand in which lower-cased texts, as functions.skills.match_bounded() finds
    them; terms of up to `short` characters must stand between word boundaries.

    Each term is anchored at the gram of eight bytes in it that texts hold least often (at itself, if it is shorter), by
    counts in a fixed number of places. Texts give the places of grams that a filter of fixed size lets pass; these meet
    the anchors by equality, and only then is the whole term compared with the text, bytes for bytes. So the dictionary
    is a table like the other, held nowhere as a whole. Equal texts are searched once.

    Defined results: terms are taken as they are, empty and null ones left out, repeated ones count once; null texts are
    empty; rows of one id are searched together; a null id is an id; other columns are ignored; empty sides give no rows."""
    rows = _texts(docs, id_col, text_col)
    found = rows.select("id", "copy").join(_by_text(rows.select("copy", "text"), terms, term_col, short), "copy")
    return found.select("id", F.explode("terms").alias("term")).distinct()


def found_terms(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", term_col: str = "term", short: int = 0) -> DataFrame:
    """Rows (id, found): the sorted terms of each id, none included; else as match_terms()."""
    rows = _texts(docs, id_col, text_col)
    found = rows.select("id", "copy").join(_by_text(rows.select("copy", "text"), terms, term_col, short), "copy", "left")
    lists = found.groupBy("id").agg(F.flatten(F.collect_set("terms")).alias("found"))
    return lists.select("id", F.array_sort(F.array_distinct("found")).alias("found"))
