"""Ranks inside every segment at once: prefix sums by (segment, range) of one global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

_PLACED = "key string, score double, pos_n long, neg_n long, part int, pos_before long, neg_before long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts before each score inside its segment and range; what a batch leaves off the next takes up."""
    from pyspark import TaskContext

    part, key, carry = TaskContext.get().partitionId(), None, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("key").dictionary_encode()
        codes = codes.indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        columns = []
        for i, name in enumerate(("pos_n", "neg_n")):
            n = batch.column(name).to_numpy(zero_copy_only=False)
            before = np.cumsum(n) - n
            start = before[first].copy()
            start[0] -= carry[i] if batch.column("key")[0].as_py() == key else 0
            columns.append(before - np.repeat(start, np.diff(np.append(first, len(n)))))
        key = batch.column("key")[batch.num_rows - 1].as_py()
        carry = np.array([c[-1] + batch.column(name)[batch.num_rows - 1].as_py() for c, name in zip(columns, ("pos_n", "neg_n"), strict=True)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), *map(pa.array, columns)], names=[c.split()[0] for c in _PLACED.split(", ")])


def by_segment(rows: DataFrame, segment: str, score: str = "score", label: str = "label", quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """A row for each segment: segment (string), n, n_pos, n_neg, roc_auc, u, ties, and a column q_<percent> a quantile.

    roc_auc counts ties half and is 0.0 if a class is missing; u is the Mann-Whitney U of the rows with a label over 0
    against the others, ties the sum of t**3 - t over equal scores; quantiles interpolate.

    Rows are counted by segment and score before they travel, and sorted over ranges by both. A task adds up its range
    with what it needs of the range alone; sums by (segment, range) then give what lies before. So a segment with a third
    of all rows, or all of them, is many ranges, and millions of small segments share one: one shuffle of rows for all.

    Defined results: a null segment is a segment of its own; null scores don't count, and a segment without others has no
    row; null labels count as 0; NaN is the greatest score; other columns are ignored; an empty table gives no rows."""
    key = F.when(F.col(segment).isNull(), "").otherwise(F.concat(F.lit("="), F.col(segment).cast("string")))
    positive = F.coalesce(F.col(label).cast("double"), F.lit(0.0)) > 0
    base = rows.filter(F.col(score).isNotNull()).select(key.alias("key"), (F.col(score).cast("double") + 0.0).alias("score"), positive.cast("long").alias("pos"))
    counts = base.groupBy("key", "score").agg(F.sum("pos").alias("pos_n"), F.sum(1 - F.col("pos")).alias("neg_n"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(counts.repartitionByRange(ranges, "key", "score").sortWithinPartitions("key", "score").mapInArrow(_running, _PLACED), "segments")
    t = (F.col("pos_n") + F.col("neg_n")).cast("double")
    below = F.col("pos_n").cast("double") * (F.col("neg_before") + F.col("neg_n") / 2)
    parts = placed.groupBy("key", "part").agg(F.sum("pos_n").alias("p"), F.sum("neg_n").alias("m"), F.sum(below).alias("below"), F.sum(t * t * t - t).alias("ties"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = written(parts.withColumns({"neg_base": F.coalesce(F.sum("m").over(before), F.lit(0)), "base": F.coalesce(F.sum(F.col("p") + F.col("m")).over(before), F.lit(0))}), "segment_parts")
    total = parts.groupBy("key").agg(F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"), F.sum(F.col("below") + F.col("p").cast("double") * F.col("neg_base")).alias("u"), F.sum("ties").alias("ties"))
    total = total.withColumn("n", F.col("n_pos") + F.col("n_neg"))
    at = placed.join(parts.select("key", "part", "base"), ["key", "part"]).join(total.select("key", "n"), "key")
    first = F.col("base") + F.col("pos_before") + F.col("neg_before")
    holds = lambda place: (first <= place) & (place < first + F.col("pos_n") + F.col("neg_n"))
    picks, ends = [], F.lit(False)
    for i, q in enumerate(quantiles):
        place = F.lit(float(q)) * (F.col("n") - 1)
        for side, where in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks.append(F.max(F.when(holds(where), F.col("score"))).alias(f"{side}{i}"))
            ends = ends | holds(where)
    if quantiles:
        total = total.join(at.filter(ends).groupBy("key").agg(*picks), "key")
    cols = []
    for i, q in enumerate(quantiles):
        place = F.lit(float(q)) * (F.col("n") - 1)
        value = F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (place - F.floor(place)))
        cols.append(value.alias(f"q_{100 * q:g}"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(0.0)
    return total.select(F.when(F.col("key") != "", F.substring("key", F.lit(2), F.char_length("key"))).alias("segment"), "n", "n_pos", "n_neg", auc.alias("roc_auc"), "u", "ties", *cols)
