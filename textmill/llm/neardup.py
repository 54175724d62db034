"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import GOLDEN, chunks, mix64, shingle_hashes, text_bytes
from .components import connected
from .scratch import discard, quoted, whole_row, written

SIGNATURE = 64
ROWS_PER_BAND = 4


def super_minhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash signatures (one row of m values a set) of sets of distinct 64-bit hashes.

    Step j gives each element the value j + u_j at place p_j, where p is a random permutation that grows by one
    exchange a step; each place keeps its least value. A set takes no further step once all of its places hold
    values of completed steps (early stopping): values are j * 2**32 + 32 random bits, so later ones are larger.
    The empty set keeps the largest value everywhere."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    low = np.full((len(sets), m), np.iinfo(np.int64).max, dtype=np.int64)
    flat = low.reshape(-1)
    if not sizes.sum():
        return low
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None  # the permutations, kept only for elements that go beyond step 0
    for j in range(m):
        draw = mix64(elements + np.uint64((j + 1) * int(GOLDEN) % 2**64))
        place = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            chosen = place
        else:
            each = np.arange(len(order))
            chosen = order[each, place].astype(np.int64)
            order[each, place] = order[:, j]
            order[:, j] = chosen
        value = (np.int64(j) << np.int64(32)) + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.minimum.at(flat, owner * m + chosen, value)
        going = low.max(axis=1) >= (np.int64(j + 1) << np.int64(32))
        stay = going[owner]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(stay.sum()), 1))
            each, first = np.arange(len(order)), place[stay]
            order[each, first] = 0
            order[:, 0] = first
        elif not stay.all():
            order = order[stay]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
    return low


_SIGNED = pa.schema([("doc_id", pa.int64()), ("copy", pa.string()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=2 << 20):
        sets = shingle_hashes(*text_bytes(batch.column("text")))
        signature = super_minhash(sets)
        rows = signature.reshape(len(sets), -1, ROWS_PER_BAND).view(np.uint64)
        band = np.arange(1, rows.shape[1] + 1, dtype=np.uint64)[None, :] * GOLDEN
        for k in range(ROWS_PER_BAND):
            band = mix64(band ^ rows[:, :, k])
        filled = np.array([len(s) > 0 for s in sets])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * band.shape[1])]).astype(np.int32)), pa.array(band[filled].view(np.int64).reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array([len(s) for s in sets], pa.int64()), lists], schema=_SIGNED)


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(chunks([batch], "text_a", 1 << 20), "text_b", 1 << 20):
                left = shingle_hashes(*text_bytes(part.column("text_a")))
                right = shingle_hashes(*text_bytes(part.column("text_b")))
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are alike enough."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(percent), "a long, b long")


#: Groups of up to this many members give pairs; larger ones are compared inside tasks, in blocks. Both compare full sets.
SMALL_GROUP = 16
#: A block holds about so many members, and so many shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 1_000_000
#: Shingles are counted in 2**SLOT_BITS places by their hash, to put rare ones first.
SLOT_BITS = 18


def spanning_links(sets: list[np.ndarray], groups: np.ndarray, percent: int, columns: int = 2048) -> list[tuple[int, int]]:
    """Links that join all groups which any pair of sets alike enough joins: fewer than there are groups.

    Intersections of all pairs come from products of incidence matrices, over the elements that two sets share at least."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    place = np.cumsum(times > 1) - 1
    used = times[which] > 1
    owner, which = owner[used], place[which[used]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    common = np.zeros((m, m), dtype=np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(which, [first, first + columns])
        block = np.zeros((m, columns), dtype=np.float32)
        block[owner[a:b], which[a:b] - first] = 1
        common += block @ block.T
    out, now = [], groups.copy()
    for i in range(m):
        both = common[i].astype(np.int64)
        linked = (both > 0) & (100 * both >= percent * (sizes + sizes[i] - both))
        while (js := np.flatnonzero(linked & (now != now[i]))).size:
            out.append((i, int(js[0])))
            now[now == now[js[0]]] = now[i]
    return out


def _block_linker(percent: int):
    def link(rows):
        import pandas as pd

        out = []
        rows = rows.drop_duplicates(["rep", "text"])
        if rows["root"].nunique() > 1:
            sets = shingle_hashes(*text_bytes(pa.array(rows["text"], pa.large_string())))
            rep = rows["rep"].to_numpy()
            out = [(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in spanning_links(sets, rows["root"].to_numpy(), percent) if rep[i] != rep[j]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return link


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each place, over all texts of a task."""
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in chunks(batches, limit=2 << 20):
        for s in shingle_hashes(*text_bytes(batch.column("text"))):
            seen += np.bincount((s >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(seen))
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used])], names=["slot", "n"])


def prefix(shingles: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n - ceil(percent * n / 100) + 1 of n shingles, in one order for all sets.

    Of two sets that are alike enough, fewer than that many elements of either are not in the other one. So the least
    common element stands in both prefixes, whatever the order is; a good one only makes them meet others rarely."""
    keep = len(shingles) + -percent * len(shingles) // 100 + 1
    return shingles[np.lexsort((shingles, seen[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:keep]] if len(shingles) else shingles


def _prefixes(seen, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            sets = [prefix(s, seen.value, percent) for s in shingle_hashes(*text_bytes(batch.column("text")))]
            take = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), *[batch.column(c).take(take) for c in ("rep", "root", "n_shingles")]], names=["key", "rep", "root", "n_shingles"])

    return run


def _crossing(bands: DataFrame, roots: DataFrame, texts: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Confirmed links, written, between texts that share a bucket but that the first links left in different groups.

    Members of buckets with more than one group are joined exactly, by the rarest shingles of each: texts alike enough
    share one. What many texts share is never among the rarest of most, so a bucket's size doesn't matter. Pairs are only
    made across groups, and the few large sets of texts with a rare shingle in common are compared inside tasks."""
    placed = bands.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    chosen = placed.join(mixed, "key", "left_semi").select("rep", "root", "n_shingles").distinct()
    members = written(chosen.join(texts, "rep").select("rep", "root", "n_shingles", "text"), "members")
    found = members.select("text").mapInArrow(_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(1 << SLOT_BITS, np.int64)
    seen[found["slot"].to_numpy()] = found["n"].to_numpy()
    rare = members.mapInArrow(_prefixes(members.sparkSession.sparkContext.broadcast(seen), percent), "key long, rep long, root long, n_shingles long")
    rare = written(rare, "rare")
    groups = rare.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    rows = written(rare.join(groups.select("key", "n", "total"), "key"), "groups")
    small = rows.filter(F.col("n") <= SMALL_GROUP)
    other = small.select("key", F.col("rep").alias("b"), F.col("root").alias("root_b"), F.col("n_shingles").alias("size_b"))
    like = (100 * F.least("n_shingles", "size_b") >= percent * F.greatest("n_shingles", "size_b")) & (F.col("root") != F.col("root_b"))
    pairs = small.withColumnRenamed("rep", "a").join(other, "key").filter("a < b").filter(like).select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
    pairs = written(pairs, "crossing")
    links = _confirmed(pairs, members.select("rep", "text"), percent)
    k = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    large = rows.filter(F.col("n") > SMALL_GROUP).withColumn("k", k).withColumn("own", F.pmod(F.hash("rep"), F.col("k")))
    tables = (members, rare, rows, pairs)
    if large.isEmpty():
        late = written(links, "late")
        for table in tables:
            discard(table)
        return late
    cells = large.select("key", "rep", "root", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "root").join(members.select("rep", "text"), "rep")
    late = written(links.union(cells.groupBy("key", "i", "j").applyInPandas(_block_linker(percent), "a long, b long")), "late")
    for table in tables:
        discard(table)
    return late


def _texts(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (rep, text) of base (doc_id, text), one for rows alike in both: else each pair of ids would be compared once
    for each pair of their rows. Texts travel for this only if there are such rows."""
    if rows.groupBy("doc_id", "copy").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return base.select(F.col("doc_id").alias("rep"), "text")
    once = base.groupBy("doc_id", F.md5("text").alias("copy")).agg(F.first("text").alias("text"))
    return written(once.select(F.col("doc_id").alias("rep"), "text"), "texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): groups of documents linked by 5-word shingle sets.

    Two documents are linked if 100 * intersection >= percent * union of their full sets; a group is what links reach.
    SuperMinHash signatures of 64 values in 16 bands of 4 find candidates (a pair at 0.85 is missed with probability
    7e-6, at 0.8 with 2e-4). Equal texts are one class before anything is compared. In each bucket every member is
    checked against two leaders of the bucket; then what shares a bucket but still lies in different groups is compared
    too, all of it, by an exact join on the rarest shingles. Copies are never expanded into pairs.

    Defined results: a null or wordless text has an empty set, is linked with nothing and is its own group; rows with a
    null id are left out; repeated ids share one group; other columns, whatever their names, are ignored; an empty
    table gives no rows. Long texts count whole."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    rows = written(base.withColumn("copy", F.md5("text")).mapInArrow(_sign, "doc_id long, copy string, n_shingles long, bands array<long>"), "rows")
    classes = rows.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    signed = written(classes, "signed")
    texts = _texts(base, rows)
    bands = signed.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lead"), F.max_by("rep", F.hash("rep")).alias("second"), F.count("*").alias("n")).filter("n > 1")
    near = bands.join(shared, "key").select("rep", F.explode(F.array("lead", "second")).alias("lead")).filter("rep <> lead")
    pairs = written(near.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct(), "pairs")
    links = written(_confirmed(pairs, texts, percent), "confirmed")
    roots = written(connected(links), "roots")
    late = _crossing(bands, roots, texts, pairs, percent)
    if not late.isEmpty():
        roots = written(connected(links.union(late)), "roots")
    for table in (pairs, links, late):
        discard(table)
    found = signed.select("rep", "copy").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("copy", F.coalesce("root", "rep").alias("group"))
    out = rows.select("doc_id", "copy", "n_shingles").join(found, "copy")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("group")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs without the documents whose group keeps another one. `percent` is that of near_duplicates().

    Of rows alike in id and text one stays; rows of one id with different texts stay all, if their id does. Rows with a
    null id are in no group and stay as they are."""
    key = F.col(quoted(id_col))
    keeps = near_duplicates(docs, id_col, text_col, percent).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(keeps, key.cast("long") == F.col("kept_id"), "left_semi")
    digest = F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    if not stay.groupBy(key, digest).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        stay = stay.select(whole_row(stay), key.alias("id"), digest.alias("copy")).groupBy("id", "copy").agg(F.first("row").alias("row")).select("row.*")
    return stay.union(docs.filter(key.isNull()))
