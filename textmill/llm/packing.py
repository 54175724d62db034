"""Packing token sequences: a linear grouping scheme for long pieces, then best fit for short ones.

The plan is made on the driver from the histogram of piece lengths, which has at most `capacity` entries whatever the
size of the corpus; pieces of one length are exchangeable, so a plan in runs of equal sequences places all of them."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks, text_bytes
from .scratch import written
from .tokens import WordEncoder

#: Pieces over this share of the capacity are long.
LONG = 0.125
#: Numbers of groups that the scheme tries; the plan with the fewest sequences is used.
GROUPS = (64, 192)


class _Bins:
    """Runs of sequences with equal contents: [first sequence, how many, tokens used], by room left."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.runs = capacity, 0, []
        self.open: dict[int, list[list[int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def _put(self, first: int, many: int, used: int) -> None:
        room = self.capacity - used
        if room not in self.open or not self.open[room]:
            bisect.insort(self.rooms, room)
        self.open[room].append([first, many, used])

    def place(self, contents: list[tuple[int, int]], many: int) -> None:
        """`many` new sequences that each hold the pieces (length, first rank) in this order."""
        used = 0
        for length, rank in contents:
            self.runs.append((length, rank, many, self.next, used))
            used += length
        if used < self.capacity:
            self._put(self.next, many, used)
        self.next += many

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Put `count` pieces where the least room is left that holds one; open sequences only if none does."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                many, rest = divmod(count, each)
                if many:
                    self.place([(length, rank + i * many) for i in range(each)], many)
                if rest:
                    self.place([(length, rank + each * many + i) for i in range(rest)], 1)
                return
            room = self.rooms[at]
            first, many, used = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            take = min(many, count)
            self.runs.append((length, rank, take, first, used))
            if take < many:
                self._put(first + take, many - take, used)
            if room > length:
                self._put(first, take, used + length)
            rank, count = rank + take, count - take


def _pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (an unbounded knapsack), and its worth."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    for k, (s, v) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if v > 1e-12:
            for a in range(s, capacity + 1, s):  # at most capacity / s blocks: each sees the one before it
                b = min(a + s, capacity + 1)
                better = best[a - s : b - s] + v > best[a:b] + 1e-12
                best[a:b][better] = best[a - s : b - s][better] + v
                chosen[a:b][better] = k
    out = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
            continue
        out[chosen[c]] += 1
        c -= int(sizes[chosen[c]])
    return float(out @ worth), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Fillings (how many of each size, how many sequences) that nearly minimise the sequences for this demand.

    Column generation on the linear programme over configurations, then its solution rounded down; what this leaves of
    the demand (less than one sequence a configuration) is not in the result."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for _ in range(rounds):
        worth = np.maximum(inverse.sum(axis=0), 0.0)
        value, column = _pattern(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.full(m, np.inf)
        ratio[step > 1e-9] = x[step > 1e-9] / step[step > 1e-9]
        out = int(np.argmin(ratio))
        x = x - step * ratio[out]
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(basis[:, i].astype(np.int64), int(x[i] + 1e-9)) for i in range(m) if x[i] + 1e-9 >= 1]


def _scheme(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int, exact: bool) -> _Bins:
    """Sequences for long pieces by linear grouping into `groups`; then all others by best fit decreasing.

    exact: the last place of a configuration takes the largest piece that fits, else one of its own group."""
    bins = _Bins(capacity)
    full = lengths == capacity
    if full.any():
        bins.place([(capacity, 0)], int(counts[full][0]))
    long = np.flatnonzero((lengths > capacity * LONG) & ~full)[::-1]  # largest first
    rest = {int(n): [0, int(c)] for n, c in zip(lengths[~full], counts[~full], strict=True)}
    if len(long):
        # equal-cardinality groups by size; each is rounded up to its largest piece
        total = int(counts[long].sum())
        bounds = np.unique(np.minimum(np.ceil(np.arange(1, groups + 1) * total / groups).astype(np.int64), total))
        members, queue = [], [[int(lengths[i]), int(counts[i])] for i in long]
        for n in np.diff(np.concatenate([[0], bounds])):
            group, need = [], int(n)
            while need:
                take = min(need, queue[0][1])
                group.append([queue[0][0], take])
                need -= take
                queue[0][1] -= take
                if not queue[0][1]:
                    queue.pop(0)
            members.append(group)
        pools: dict[int, list[int]] = {}  # groups of the same rounded size are one size
        for group in members:
            pools.setdefault(group[0][0], []).extend(n for n, _ in group)
        sizes = np.array(list(pools), dtype=np.int64)
        demand = np.zeros(len(sizes))
        for group in members:
            demand[list(pools).index(group[0][0])] += sum(c for _, c in group)
        have = sorted(rest)
        for filling, many in configurations(sizes, demand, capacity):
            slots = [int(sizes[g]) for g in np.flatnonzero(filling) for _ in range(filling[g])]
            while many:
                taken, room = [], capacity
                for k, size in enumerate(slots):
                    if exact and k == len(slots) - 1:
                        at = bisect.bisect_right(have, room) - 1
                        n = have[at] if at >= 0 else 0
                    else:
                        n = next((x for x in pools[size] if rest[x][1] > taken.count(x)), 0)
                    if n and n <= room and rest[n][1] > taken.count(n):
                        taken.append(n)
                        room -= n
                if not taken:
                    break
                width = min(many, *(rest[n][1] // taken.count(n) for n in set(taken)))
                contents = []
                for n in taken:
                    contents.append((n, rest[n][0]))
                    rest[n][0] += width
                    rest[n][1] -= width
                for n in set(taken):
                    if not rest[n][1]:
                        have.remove(n)
                bins.place(contents, width)
                many -= width
    for n in sorted(rest, reverse=True):
        rank, count = rest[n]
        if count:
            bins.best_fit(n, rank, count)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): the pieces of one length with ranks from the first one
    on take consecutive sequences at that offset. Long pieces are grouped, rounded up, configured and substituted."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    return min((_scheme(lengths, counts, capacity, g, exact) for g in GROUPS for exact in (True, False)), key=lambda b: b.next).runs


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int32()), ("rank", pa.int64())])


def _cutter(ranks_path: str, pattern: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), WordEncoder(ranks_path, pattern)
        for batch in chunks(batches):
            rows = [[] for _ in range(5)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(*text_bytes(batch.column("text"))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                pieces = -(-len(ids) // capacity)
                begin = 0
                for piece in range(pieces):
                    end = len(ids) - capacity * (pieces - 1 - piece)
                    for out, value in zip(rows, (doc_id, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())), strict=True):
                        out.append(value)
                    begin = end
            ranks = []
            for n in rows[3]:
                ranks.append(seen[n])
                seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip([*rows, [block] * len(ranks), ranks], _PIECES, strict=True)], schema=_PIECES)

    return cut


def _placer(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    span = int(table[:, 1].max(initial=0)) + 1
    keys = table[:, 0].astype(object) * span + table[:, 1].astype(object) if span > 2**50 else table[:, 0] * span + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(table[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): whole texts as token pieces in sequences.

    A document is the ids of its text and then end_id. One longer than `capacity` is cut into pieces of that length,
    of which the first may be shorter. The pieces are then packed: all pieces over an eighth of the capacity by linear
    grouping (equal-cardinality groups by size, rounded up to their largest piece; column generation over the few sizes;
    actual pieces put in the places), what is left and the small ones by best fit, largest first.

    Texts are encoded once and only pieces, without ids, are shuffled. A piece's rank among those of its length is its
    rank in its task plus the counts of the tasks before.

    Defined results: null and empty texts are one piece with the end id alone; a null id stays null; rows that repeat an
    id are packed each; other columns are ignored; an empty table gives no rows."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"
    pieces = written(base.mapInArrow(_cutter(ranks_path, pattern, end_id, capacity), schema), "pieces")
    counts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "block", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(plan(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
