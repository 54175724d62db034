"""Exact nearest vectors by cells: pivots, distances to them and the triangle inequality tell which cells a query needs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .search import dense, unit

#: Cells are the square root of the number of candidates, PIVOTS at most: that many vectors are sent to all tasks.
PIVOTS = 16_384
#: Candidates of a cell that meet queries in one task, about; those of larger cells are dealt over several.
ROWS = 16_384
#: Queries that a task can meet; more are taken in blocks, each of which meets the cells.
QUERIES = 250_000
#: Rounding errors of distances and products are below this.
SLACK = 1e-6

_NEEDS = "q long, cell int, near double, bound double, shares int, vector array<double>"


class _Space:
    """The pivots and what is known of their cells: how many rows, the least and greatest distance to the pivot,
    and over how many tasks they are dealt."""

    def __init__(self, pivots: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, shares: np.ndarray):
        self.pivots, self.n, self.low, self.high, self.shares = pivots, n, low, high, shares


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit (or zero) rows to unit pivots."""
    squares = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _placed(pivots, width: int):
    """Each candidate's cell, that of the nearest pivot, and its distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                far = distances(unit(dense(batch.column("vector"), width)), pivots.value)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell]), batch.column("vector")], names=["d", "cell", "far", "vector"])

    return run


def _wanted(space, width: int, sign: int, k: int, first: bool):
    """The cells that each query needs. At first its nearest ones, till they hold k rows besides itself; later, with the
    k-th best distance known (bound), the others that can have a row at that distance or nearer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Space = space.value
        used = known.n > 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = sign * unit(dense(batch.column("vector"), width))
                far = distances(rows, known.pivots)
                order = np.argsort(np.where(used, far, np.inf), axis=1, kind="stable")
                before = np.cumsum(known.n[order], axis=1) - known.n[order]
                early = np.zeros(far.shape, bool)
                np.put_along_axis(early, order, (before < k + 1) & used[order], axis=1)
                if first:
                    wanted, bound = early, np.full(len(rows), np.inf)
                else:
                    bound = pc.fill_null(batch.column("bound"), np.inf).to_numpy(zero_copy_only=False)
                    gap = np.maximum(np.maximum(far - known.high, known.low - far), 0)
                    wanted = used & ~early & (gap <= bound[:, None] + SLACK)
                q, cell = np.nonzero(wanted)
                take = pa.array(q)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * width, pa.int32()), pa.array(rows[q].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("q").take(take), pa.array(cell, pa.int32()), pa.array(far[q, cell]), pa.array(bound[q]), pa.array(known.shares[cell]), vectors], names=["q", "cell", "near", "bound", "shares", "vector"])

    return run


def _points(given: DataFrame, total: int, width: int, pivots: int) -> np.ndarray:
    """About `pivots` different unit vectors, of rows that their hash chooses; twice as many at most."""
    share = min(1.0, pivots / max(1, total))
    rows = given.filter(F.size("vector") > 0).filter(F.pmod(F.xxhash64("d", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = rows.select("vector").distinct().limit(2 * pivots).toArrow()
    found = unit(dense(rows.column("vector").combine_chunks(), width)) if rows.num_rows else np.zeros((0, width))
    found = found[(found * found).sum(axis=1) > 0.5]
    return found if len(found) else np.zeros((1, width))


def _met(k: int, different: bool, width: int):
    """The best k of a share of a cell for each query of a block, and how many products that took."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            far = right.column("far").to_numpy()
            order = np.argsort(far, kind="stable")
            far, ids = far[order], right.column("d").to_numpy()[order]
            rows = unit(dense(right.column("vector").combine_chunks(), width))[order]
            queries = dense(left.column("vector").combine_chunks(), width)
            near, bound, names = (left.column(c).to_numpy() for c in ("near", "bound", "q"))
            # a row is at least |its distance to the pivot - the query's| away
            start = np.searchsorted(far, near - bound - SLACK, "left")
            stop = np.searchsorted(far, near + bound + SLACK, "right")
            for i in range(len(names)):
                part = slice(start[i], stop[i])
                scores = (rows[part] * queries[i]).sum(axis=1)  # the same order of sums wherever a row stands
                mine = ids[part]
                if different:
                    scores, mine = scores[mine != names[i]], mine[mine != names[i]]
                best = np.lexsort((mine, -scores))[:k]
                out += [(int(names[i]), int(mine[j]), float(scores[j]), 0) for j in best]
                out.append((int(names[i]), None, None, int(stop[i] - start[i])))
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["q", "d", "score", "n"])

    return run


def nearest_by_cells(queries: DataFrame, candidates: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", largest: bool = True, different: bool = False, pivots: int | None = None, rows: int = ROWS) -> DataFrame:
    """Rows (query, doc, score, rank, total_candidates, compared): as search.nearest(), without most of the products.

    Candidates are dealt into cells around `pivots` of them. A query meets its nearest cells first, which bounds how far
    its k-th best can be; then only cells that reach into that distance, and of these only rows whose distance to the
    pivot differs from the query's by no more. Both follow from the triangle inequality, so the result is exact, with
    ties by the lesser id. For the least cosines the query is turned round. `compared` counts a query's products.

    Queries are rows like candidates: neither side is held by the driver or sent whole to all tasks, and their number
    changes no plan. A cell of more than `rows` candidates is dealt over several tasks, and so are queries that meet it,
    so copies of one vector, which no pivot can part, are split too. What prunes is the closeness of the data: among
    unrelated vectors of many dimensions all cells can be needed, and all products are made.

    Defined results: null, empty and zero vectors have cosine 0 with anything; null ids are left out; repeated ids are
    rows of their own on the candidates' side, and count once on the queries'; fewer than k candidates are all given; an
    empty side gives no rows; other columns are ignored; vectors of unequal lengths are an error."""
    pick = lambda side, key, name: side.select(F.col(key).cast("long").alias(name), F.col("vector").cast("array<double>").alias("vector")).filter(F.col(name).isNotNull())
    asked, given = pick(queries, query, "q").dropDuplicates(["q"]), pick(candidates, doc, "d")
    width = next((r["n"] for side in (asked, given) for r in side.select(F.size("vector").alias("n")).filter("n > 0").limit(1).collect()), 0)
    spark = queries.sparkSession
    n_queries, total = asked.count(), given.count()
    points = _points(given, total, width, min(PIVOTS, max(16, math.isqrt(total))) if pivots is None else pivots)
    placed = given.mapInArrow(_placed(spark.sparkContext.broadcast(points), width), "d long, cell int, far double, vector array<double>")
    placed = written(placed, "cells")
    sized = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.ceil(F.count("*") / rows).cast("int").alias("shares"))
    space = _Space(points, *(np.zeros(len(points), t) for t in (np.int64, float, float, np.int32)))
    for r in sized.collect():  # a row a pivot
        space.n[r["cell"]], space.low[r["cell"]], space.high[r["cell"]], space.shares[r["cell"]] = r["n"], r["low"], r["high"], r["shares"]
    space = spark.sparkContext.broadcast(space)
    blocks = max(1, -(-n_queries // QUERIES))
    keys = ["cell", "share", "block"]
    dealt = placed.join(F.broadcast(sized.select("cell", "shares")), "cell").withColumn("share", F.pmod(F.xxhash64("d", "far"), F.col("shares")).cast("int"))
    dealt = dealt.select("cell", "share", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "d", "far", "vector")
    sign = 1 if largest else -1

    def meet(rows_of: DataFrame, first: bool) -> DataFrame:
        needs = rows_of.mapInArrow(_wanted(space, width, sign, k, first), _NEEDS)
        needs = needs.select("q", "cell", "near", "bound", "vector", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
        return needs.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_met(k, different, width), "q long, d long, score double, n long")

    by = Window.partitionBy("q")
    one = written(meet(asked, True), "near_cells")
    kth = one.filter("d is not null").withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "d"))).filter(F.col("place") == k)
    # the distance of unit vectors with that product; zero vectors, with product 0, are nearer than this bound
    bound = kth.select("q", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))
    found = one.union(meet(asked.join(bound, "q", "left"), False))
    ranked = found.withColumns({"rank": F.row_number().over(by.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("d"))), "compared": F.sum("n").over(by)})
    best = ranked.filter((F.col("rank") <= k) & F.col("d").isNotNull()).withColumn("own", F.lit(0))
    if different:
        own = placed.select(F.col("d").alias("q")).join(asked.select("q"), "q", "left_semi").groupBy("q").agg(F.count("*").alias("own"))
        best = best.drop("own").join(own, "q", "left")
    score = F.when(F.col("score") == 0, 0.0).otherwise(sign * F.col("score"))
    return best.select(F.col("q").alias(query), F.col("d").alias(doc), score.alias("score"), "rank", (F.lit(total) - F.coalesce("own", F.lit(0))).cast("long").alias("total_candidates"), "compared")
