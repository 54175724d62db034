"""Ranking and classification metrics over rows (query, pos, score, label).

Order inside a query: score descending, then pos descending (the later of equals first)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.shared import written
from .quantiles import elements, quantiles


def ranked(scored: DataFrame, query: str = "query_id") -> DataFrame:
    """scored plus rn, the rank, ideal, the rank by label, and hits, the relevant rows so far. Null labels count 0."""
    rows = scored.withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(0)))
    by = Window.partitionBy(query).orderBy(F.desc("score"), F.desc("pos"))
    rows = rows.withColumn("rn", F.row_number().over(by))
    hits = F.sum("label").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the ideal order only matters through the labels, so any order of equals will do
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("label"), F.desc("rn")))
    return rows.withColumns({"hits": hits, "ideal": ideal})


def per_query(scored: DataFrame, k_values: tuple[int, ...] = (1, 3, 5, 10), query: str = "query_id") -> DataFrame:
    """One row a query: p_at_k, r_at_k, ndcg_at_k for each k, mrr, ap, n and n_relevant."""
    rows = ranked(scored, query)
    relevant = F.sum("label")

    def within(k: int, value: Column, rank: str = "rn") -> Column:
        return F.coalesce(F.sum(F.when(F.col(rank) <= k, value)), F.lit(0))

    out = [F.count("*").alias("n"), relevant.alias("n_relevant")]
    for k in k_values:
        gain = lambda rank: F.col("label") / F.log2(F.col(rank) + 1)
        best = within(k, gain("ideal"), "ideal")
        if k <= 0:
            out += [F.lit(0.0).alias(f"{m}_at_{k}") for m in ("p", "r", "ndcg")]
            continue
        out += [
            (within(k, F.col("label")) / k).alias(f"p_at_{k}"),
            F.when(relevant > 0, within(k, F.col("label")) / relevant).otherwise(0.0).alias(f"r_at_{k}"),
            F.when(best > 0, within(k, gain("rn")) / best).otherwise(0.0).alias(f"ndcg_at_{k}"),
        ]
    first = F.min(F.when(F.col("label") == 1, F.col("rn")))
    out += [F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), F.when(relevant > 0, F.sum(F.when(F.col("label") > 0, F.col("hits") / F.col("rn"))) / relevant).otherwise(0.0).alias("ap")]
    return rows.groupBy(query).agg(*out)


def measures(labels: np.ndarray, k_values: tuple[int, ...] = (1, 3, 5, 10)) -> dict[str, float]:
    """What per_query() says of a query, from its labels (whole numbers) in order."""
    places, relevant = np.arange(1, len(labels) + 1), int(labels.sum())
    out: dict[str, float] = {"n": len(labels), "n_relevant": relevant}
    most = max([*k_values, 0])
    ideal = np.sort(labels)[::-1][:most]
    for k in k_values:
        top, best = labels[: max(k, 0)], ideal[: max(k, 0)]
        gain, most_gain = ((x / np.log2(np.arange(2, len(x) + 2))).sum() for x in (top, best))
        out |= {f"p_at_{k}": float(top.sum() / k) if k > 0 else 0.0, f"r_at_{k}": float(top.sum() / relevant) if relevant > 0 else 0.0, f"ndcg_at_{k}": float(gain / most_gain) if most_gain > 0 else 0.0}
    first, found = np.flatnonzero(labels == 1), labels > 0
    out["mrr"] = 1.0 / float(places[first[0]]) if len(first) else 0.0
    out["ap"] = float((np.cumsum(labels)[found] / places[found]).sum() / relevant) if relevant > 0 else 0.0
    return out


def measures_schema(query: str, k_values: tuple[int, ...]) -> StructType:
    names = [*[f"{m}_at_{k}" for k in k_values for m in ("p", "r", "ndcg")], "mrr", "ap"]
    return StructType([StructField(query, LongType()), StructField("n", LongType()), StructField("n_relevant", LongType()), *[StructField(c, DoubleType()) for c in names]])


def aggregate(scored: DataFrame, k_values: tuple[int, ...] = (1, 3, 5, 10), query: str = "query_id", pooled: bool = True) -> DataFrame:
    """One row: the means over queries (ap as map), num_queries and, unless left out, the pooled roc_auc."""
    each = per_query(scored, k_values, query)
    names = [f"{m}_at_{k}" for k in k_values for m in ("p", "r", "ndcg")]
    means = each.agg(F.count("*").alias("num_queries"), *[F.avg(c).alias(c) for c in names], F.avg("mrr").alias("mrr"), F.avg("ap").alias("map"))
    return means.crossJoin(roc_auc(scored)) if pooled else means  # one row each


def flat(scored: DataFrame, k_values: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """All rows as one list: one row of metrics, with roc_auc.

    Equal scores are told apart by pos, so ranks are global: they come from counts of sorted ranges, not from one task."""
    rows = scored.select("score", "pos", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"))
    most = max([*k_values, 1])
    head = rows.orderBy(F.desc("score"), F.desc("pos")).limit(most).withColumn("q", F.lit(0))
    top = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("pos"))  # at most max(k) rows
    head = head.withColumn("rn", F.row_number().over(top))
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_relevant"))
    parts = []
    for k in k_values:
        parts += [F.coalesce(F.sum(F.when(F.col("rn") <= k, F.col("label"))), F.lit(0)).alias(f"hits_{k}"), F.coalesce(F.sum(F.when(F.col("rn") <= k, F.col("label") / F.log2(F.col("rn") + 1))), F.lit(0.0)).alias(f"dcg_{k}")]
    tops = head.agg(*parts)
    out = whole.crossJoin(tops).crossJoin(_precision_sums(rows)).crossJoin(roc_auc(rows))
    cols = ["n", "n_relevant"]
    for k in k_values:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        cols += [(F.col(f"hits_{k}") / k).alias(f"p_at_{k}"), F.when(F.col("n_relevant") > 0, F.col(f"hits_{k}") / F.col("n_relevant")).otherwise(0.0).alias(f"r_at_{k}"), F.when(F.col("n_relevant") > 0, F.col(f"dcg_{k}") / ideal).otherwise(0.0).alias(f"ndcg_{k}").alias(f"ndcg_at_{k}")]
    return out.select(*cols, F.when(F.col("n_relevant") > 0, F.col("precisions") / F.col("n_relevant")).otherwise(0.0).alias("ap"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), "roc_auc")


def global_ranks(rows: DataFrame, *order: Column, buckets: int | None = None) -> DataFrame:
    """rows plus rn, their place in the whole order, and hits, the labels up to them, without a window over everything.

    Rows are sorted into ranges; a range's rows are counted, and each gets the counts of the ranges before it. Limits of
    ranges come from a sample, so both readings must have the same ranges: the placed rows are written to the shared
    folder, where they outlive lost executors, and go with the driver."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range").orderBy(*order)
    placed = placed.withColumns({"in_range": F.row_number().over(inside), "in_hits": F.sum("label").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = written(placed, "ranks")
    totals = placed.groupBy("range").agg(F.count("*").alias("c"), F.sum("label").alias("l")).withColumn("g", F.lit(0))
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = totals.select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("base_hits"))
    return placed.join(F.broadcast(bases), "range").withColumns({"rn": F.col("base") + F.col("in_range"), "hits": F.col("base_hits") + F.col("in_hits")}).drop("range", "in_range", "in_hits", "base", "base_hits")


def _precision_sums(rows: DataFrame) -> DataFrame:
    placed = global_ranks(rows, F.desc("score"), F.desc("pos"))
    return placed.filter("label > 0").agg(F.coalesce(F.sum(F.col("hits") / F.col("rn")), F.lit(0.0)).alias("precisions"), F.min(F.when(F.col("label") == 1, F.col("rn"))).alias("first"))


def score_counts(scored: DataFrame) -> DataFrame:
    """Rows (score, pos_n, neg_n): how many of each class have a score. Everything pooled starts from these."""
    label = F.coalesce(F.col("label").cast("int"), F.lit(0))
    return scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum((label > 0).cast("long")).alias("pos_n"), F.sum((label <= 0).cast("long")).alias("neg_n"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row (roc_auc), ties counting half; 0.0 if a class is missing.

    Works on counts by distinct score, placed in sorted ranges: pairs below = negatives before + half of those level."""
    counts = score_counts(scored).withColumn("label", F.col("neg_n"))
    placed = global_ranks(counts, F.asc("score"))
    total = placed.agg(F.sum(F.col("pos_n") * (F.col("hits") - F.col("neg_n") / 2)).alias("below"), F.sum("pos_n").alias("p"), F.sum("neg_n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("below") / (F.col("p").cast("double") * F.col("n"))).otherwise(0.0).alias("roc_auc"))


def classification_report(predicted: DataFrame, truth: str = "label", guess: str = "predicted") -> DataFrame:
    """Rows (class, precision, recall, f1, support): each class, then accuracy, macro avg and weighted avg."""
    cells = predicted.groupBy(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("right")))).alias("x")).select("x.*")
    each = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("right").alias("right"))
    p = F.when(F.col("guessed") > 0, F.col("right") / F.col("guessed")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("right") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    each = each.select("class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "right")
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    total = each.agg(*[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[mean(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")], F.sum("support").alias("support"), (F.sum("right") / F.sum("support")).alias("accuracy"))
    row = lambda name, a, b, c: F.struct(F.lit(name).alias("class"), a.alias("precision"), b.alias("recall"), c.alias("f1"), F.col("support").alias("support"))
    acc = F.col("accuracy")
    tail = total.select(F.explode(F.array(row("accuracy", acc, acc, acc), row("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")), row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")))).alias("x")).select("x.*")
    return each.drop("right").unionByName(tail)


def threshold_interpolated(scored: DataFrame, q: float = 0.5) -> DataFrame:
    """One row (threshold): the q-th quantile with linear interpolation; null without scores. Null scores don't count.

    By radix selection: four readings of the scores, no sort and no copy."""
    return scored.sparkSession.createDataFrame([(quantiles(scored, [q])[0],)], "threshold double")


def threshold_element(scored: DataFrame, q: float = 0.75) -> DataFrame:
    """One row (threshold): the element of index int(n*q) in ascending order; null without scores. Null scores don't count."""
    _, values = elements(scored, lambda n: [min(int(n * q), n - 1)])
    return scored.sparkSession.createDataFrame([(next(iter(values.values()), None),)], "threshold double")


def classify(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    """scored plus predicted: 1 where the score is strictly over the threshold."""
    return scored.crossJoin(F.broadcast(threshold)).withColumn("predicted", (F.col("score") > F.col("threshold")).cast("int"))


def evaluate(scored: DataFrame, percentile: float = 0.5, k_values: tuple[int, ...] = (1, 3, 5, 10), query: str = "query_id") -> dict[str, DataFrame]:
    """Everything about one scored list: flat, per_query, aggregate, threshold and report."""
    limit = threshold_interpolated(scored, percentile)
    named = scored.withColumn(query, F.col(query).cast("string"))
    return {"flat": flat(scored, k_values), "per_query": per_query(named, k_values, query), "aggregate": aggregate(named, k_values, query), "threshold": limit, "report": classification_report(classify(scored, limit))}
