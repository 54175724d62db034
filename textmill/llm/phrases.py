"""Phrase collocations by vertical positional inverted lists: frequent phrases are extended by merge-joining positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER_ASCII, chunks, text_bytes, word_spans
from .scratch import batches_of, discard, quoted, release, written

#: Whole documents of about so many bytes have their lists in one row; a longer document is alone.
BLOCK_BYTES = 2 << 20
#: Rows go to Python in so many bytes at a time; a larger row is alone.
BATCH_BYTES = 2 << 20
#: Words are found in so many bytes of them at a time.
PART_BYTES = 1 << 20
LONGEST = 3

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False

_BLOCK = "block long, langs array<string>, words array<string>, lang array<int>, sizes array<long>, positions binary"
_KEPT = "block long, ids array<long>, sizes array<long>, positions binary"


def inverted_lists(texts: pa.Array, langs: pa.Array) -> dict:
    """The positions of each word of each language in one block of documents.

    Positions count words; a place is left out between pieces, so that neighbours stand at p and p + 1. Lists are ordered
    by word and rise. Words are told apart by their bytes."""
    known = langs.dictionary_encode()
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts, codes, places, ways, last = [], [], [], max(1, len(known.dictionary)), 0
    for some in chunks([pa.RecordBatch.from_arrays([texts, known.indices], names=["text", "lang"])], limit=PART_BYTES):
        words, lang, place = _words(some)
        if len(place):
            parts.append(words)
            codes.append(lang)
            places.append(place + last)
            last = int(places[-1][-1]) + 2  # no text goes on in the next part
    if not parts:
        return {"langs": known.dictionary, "words": pa.array([], pa.large_string()), "lang": np.zeros(0, np.int32), "sizes": np.zeros(0, np.int64), "positions": np.zeros(0, np.int32)}
    words = pa.chunked_array(parts).unify_dictionaries()
    dictionary = words.chunk(words.num_chunks - 1).dictionary
    code = np.concatenate([w.indices.to_numpy(zero_copy_only=False).astype(np.int64) * ways + c for w, c in zip(words.chunks, codes, strict=True)])
    positions = np.concatenate(places).astype(np.int32)
    del parts, codes, places, words
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    word, lang = np.divmod(code[first], ways)
    return {"langs": known.dictionary, "words": dictionary.take(pa.array(word)), "lang": lang.astype(np.int32), "sizes": np.diff(np.append(first, len(code))), "positions": positions[order]}


def _words(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of some whole texts in order, with their languages and places from 0 on."""
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER_ASCII[data]
    starts, ends, doc = word_spans(data, offsets, _INSIDE)
    stops = np.flatnonzero(_ENDS[data])
    gap = np.zeros(len(starts), dtype=np.int64)
    if len(starts):
        gap[1:] = (doc[1:] != doc[:-1]) | (np.searchsorted(stops, starts[1:]) != np.searchsorted(stops, ends[:-1]))
    where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(data[_INSIDE[data]])).dictionary_encode()
    return words, batch.column("lang").to_numpy(zero_copy_only=False)[doc].astype(np.int32), (np.arange(len(starts)) + np.cumsum(gap)).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents across the batches of a task."""
    from pyspark import TaskContext

    held: list[pa.RecordBatch] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def block():
        rows = pa.Table.from_batches(held)
        lists = inverted_lists(rows.column("text"), rows.column("lang").combine_chunks())
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if isinstance(x, np.ndarray) else x.cast(kind))
        columns = [pa.array([number], pa.int64()), whole(lists["langs"], pa.string()), whole(lists["words"], pa.string()), whole(lists["lang"], pa.int32()), whole(lists["sizes"], pa.int64()), pa.array([lists["positions"].tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

    for batch in chunks(batches, limit=1 << 20):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield block()
            held, size, number = [], 0, number + 1
    if held:
        yield block()


def merged(sizes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists merged by position: which list each position, in rising order, comes from."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(positions, kind="stable")
    return owner[order], positions[order]


def neighbours(owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the merged lists at which the next word's list goes on: the merge join of each list with its neighbours'."""
    return np.flatnonzero(at[1:] == at[:-1] + 1)


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))


def _keep(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's lists of frequent words only, named by the words' numbers."""
    names = [c.split()[0] for c in _KEPT.split(", ")]
    if not left.num_rows or not right.num_rows:
        empty = [pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
        return pa.table(empty, names=names)
    sizes = left.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    positions = _positions(left)
    slot = right.column("slot").to_numpy()
    order = np.argsort(slot)
    slot, ids = slot[order], right.column("id").to_numpy()[order]
    frequent = np.zeros(len(sizes), dtype=bool)
    frequent[slot] = True
    kept = positions[np.repeat(frequent, sizes)]
    return pa.table([left.column("block"), _list(ids), _list(sizes[slot]), pa.array([kept.tobytes()], pa.binary())], names=names)


def _positions(block: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The positions of the only row, not copied."""
    return np.frombuffer(block.column("positions")[0].as_buffer(), np.int32)


def _read(block: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, which of them stands at each place, places) of a block, merged by position."""
    ids, sizes = (block.column(c)[0].values.to_numpy() for c in ("ids", "sizes"))
    return ids, *merged(sizes, _positions(block))


def _counted(codes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes as (left, right) parts, with the lengths of their lists."""
    each, n = np.unique(codes, return_counts=True)
    return *np.divmod(each, ways), n


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How long the lists of two-word phrases are in each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids, owner, at = _read(row)
            go_on = neighbours(owner, at)
            a, b, n = _counted(owner[go_on].astype(np.int64) * len(ids) + owner[go_on + 1], max(1, len(ids)))
            for k in range(0, len(a), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), row.column("block")[0].as_py()), pa.int64()), pa.array(ids[a[part]]), pa.array(ids[b[part]]), pa.array(n[part], pa.int64())], names=["block", "a", "b", "n"])


def _triples(left: pa.Table, right: pa.Table) -> pa.Table:
    """How long the lists of three-word phrases are in a block: lists of frequent pairs (right), each joined with the
    postings of the word that follows. A phrase can only be frequent if both of its pairs are."""
    names = ["a", "b", "c", "n"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    ids, owner, at = _read(left)
    order = np.argsort(ids)
    a, b = (order[np.searchsorted(ids, right.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
    frequent = np.sort(a.astype(np.int64) * len(ids) + b)
    go_on = neighbours(owner, at)
    code = owner[go_on].astype(np.int64) * len(ids) + owner[go_on + 1]
    slot = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
    hit = frequent[slot] == code
    go_on, slot = go_on[hit], slot[hit]  # the merged lists of frequent pairs: place and number of each
    twice = np.flatnonzero(go_on[1:] == go_on[:-1] + 1)
    pair, last, n = _counted(slot[twice] * len(ids) + owner[go_on[twice + 1] + 1], max(1, len(ids)))
    first, second = np.divmod(frequent[pair], len(ids))
    return pa.table([pa.array(ids[first]), pa.array(ids[second]), pa.array(ids[last]), pa.array(n, pa.int64())], names=names)


def _score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda x: f"cast({x} as decimal(16,0))"
    return f"(1000000BD * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})"


def _frequent(docs: DataFrame, least: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, id), words of each language (lang, n), frequent pairs (a, b, f) and triples (a, b, c, f) of ids."""
    base = docs.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"), F.coalesce(F.col(quoted(lang_col)), F.lit("und")).alias("lang"))
    blocks = written(base.mapInArrow(_blocks, _BLOCK), "blocks")
    headers = blocks.select("block", "langs", F.posexplode(F.arrays_zip("words", "lang", "sizes")).alias("slot", "word"))
    headers = headers.select("block", "slot", F.get("langs", F.col("word.lang")).alias("lang"), F.col("word.words").alias("word"), F.col("word.sizes").alias("n"))
    counted = written(headers.groupBy("lang", "word").agg(F.sum("n").alias("f")), "counted")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(counted.filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "words")
    frequent = written(headers.join(words, ["lang", "word"]).select("block", "slot", "id"), "frequent")
    lists = blocks.select("block", "sizes", "positions")  # a cogroup reads all columns that it is given: words stay out
    kept = written(lists.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(_keep, _KEPT), "kept")
    discard(blocks)
    discard(frequent)
    release(docs.sparkSession)
    by_phrase = Window.partitionBy("a", "b")
    pairs = kept.mapInArrow(_pairs, "block long, a long, b long, n long").withColumn("f", F.sum("n").over(by_phrase)).filter(F.col("f") >= least)
    pairs = written(pairs.select("block", "a", "b", "f"), "pairs")
    release(docs.sparkSession)
    triples = kept.groupBy("block").cogroup(pairs.select("block", "a", "b").groupBy("block")).applyInArrow(_triples, "a long, b long, c long, n long")
    triples = written(triples.groupBy("a", "b", "c").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "triples")
    two = written(pairs.groupBy("a", "b").agg(F.first("f").alias("f")), "two")
    discard(kept)
    discard(pairs)
    return words, totals, two, triples


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two or three words by score.

    A phrase stands at least `least` times within pieces (texts cut at .,;:!? and line ends). Its score is that of the
    weakest cut, 1000000 a a / (l r) rounded down, with a, l, r the frequencies of the phrase and of both parts; n counts
    all words of the language. Phrases inside a longer one that has `percent` of their frequency go.

    Blocks of documents hold an inverted list of positions for each word. Only the lengths of lists travel, to be summed
    by word or phrase; what is frequent over all blocks comes back to the blocks that have it. There the lists of
    frequent words are joined with their neighbours' postings by merging positions, then those of frequent pairs. So a
    word that is everywhere is one row a block, and no list is ever gathered over blocks.

    Defined results: a null language is 'und'; null and empty texts and pieces without words give nothing; repeated rows
    count each; equal scores are in order of a, then of the phrase's bytes; other columns, whatever their names, are
    ignored; an empty table gives no rows. Long texts count whole: one text's lists are in one row, at 4 bytes a word."""
    with batches_of(docs.sparkSession, BATCH_BYTES):
        words, totals, two, triples = _frequent(docs, least, text_col, lang_col)
    # every candidate with the frequencies of its parts
    inside = triples.select("a", "b", "f").union(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
    longer = inside.groupBy("a", "b").agg(F.max("f").alias("longer"))
    alone = two.join(longer, ["a", "b"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("f"), F.lit(True)))
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"))
    lang = words.select(F.col("id").alias("a"), "lang")
    of_two = alone.join(lang, "a").join(name("a"), "a").join(name("b"), "b")
    of_two = of_two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"))
    of_two = of_two.withColumn("score", F.expr(_score("a", "l", "r")))
    pair = lambda x, y, f: two.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f))
    of_three = triples.join(pair("a", "b", "f_ab"), ["a", "b"]).join(pair("b", "c", "f_bc"), ["b", "c"]).join(lang, "a").join(name("a"), "a").join(name("b"), "b").join(name("c"), "c")
    of_three = of_three.withColumns({"first": F.expr(_score("f", "f_a", "f_bc")), "second": F.expr(_score("f", "f_ab", "f_c"))})
    early = F.col("first") <= F.col("second")
    of_three = of_three.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"), F.when(early, F.col("f_a")).otherwise(F.col("f_ab")).alias("l"), F.when(early, F.col("f_bc")).otherwise(F.col("f_c")).alias("r"), F.least("first", "second").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = of_two.union(of_three).withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
