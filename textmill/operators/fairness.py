"""Audits of rankings by group: proxies, selection, adverse impact, score distributions, a rank test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GROUP_CUES, GROUP_NAMES
from ..functions.text import let, strip
from .metrics import global_ranks, threshold_interpolated


def group_proxy(text: Column, cues: dict[str, list[str]] = GROUP_CUES, names: dict[str, list[str]] = GROUP_NAMES, bonus: int = 5, least: int = 2) -> Column:
    """The group with strictly the most cue words, and `least` of them at least; else 'unknown'. A first name as the
    first word of the first line counts `bonus`, for the first group that has it. A rough proxy, for audits only."""
    def proxy(low: Column) -> Column:
        first = F.split(strip(F.substring_index(low, "\n", 1)), r"\s+")[0]
        counts: dict[str, Column] = {}
        named = F.lit(False)
        for group, words in cues.items():
            called = first.isin(names.get(group, [])) if names.get(group) else F.lit(False)
            # words between boundaries can't overlap: one pattern counts all of them
            hits = F.regexp_count(low, F.lit(rf"\b(?:{'|'.join(words)})\b")) if words else F.lit(0)
            counts[group] = hits + F.when(called & ~named, bonus).otherwise(0)
            named = named | called
        out = F.lit("unknown")
        for group, n in counts.items():
            wins = n >= least
            for other, m in counts.items():
                if other != group:
                    wins = wins & (n > m)
            out = F.when(wins, F.lit(group)).otherwise(out)
        return out

    return let(F.lower(F.coalesce(text, F.lit(""))), proxy)


def risk_level(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "LOW").when(ratio >= 0.6, "MODERATE").when(ratio >= 0.4, "HIGH").otherwise("CRITICAL")


def select_rows(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """scored plus selected: score >= threshold, by default the median of all scores."""
    if threshold is not None:
        return scored.withColumn("selected", F.col("score") >= threshold)
    limit = threshold_interpolated(scored, 0.5).select(F.col("threshold").alias("__limit"))
    return scored.crossJoin(F.broadcast(limit)).withColumn("selected", F.col("score") >= F.col("__limit")).drop("__limit")


def group_distribution(rows: DataFrame, group: str = "group", digits: int = 4) -> DataFrame:
    """Rows (group, n, mean_score, selected_count, selection_rate)."""
    chosen = F.sum(F.col("selected").cast("int"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg("score"), digits).alias("mean_score"), chosen.alias("selected_count"), F.round(chosen / F.count("*"), digits).alias("selection_rate"))


def adverse_impact(rows: DataFrame, a: str, b: str, group: str = "group", threshold: float = 0.8, digits: int = 4) -> DataFrame:
    """One row (rate_a, rate_b, adverse_impact_ratio, passes, risk_level): the lower rate over the higher one.

    Rates of absent groups are 0; two rates of 0 give 1. The comparison is made before rounding."""
    def rate(name: str) -> Column:
        n = F.sum((F.col(group) == name).cast("int"))
        return F.when(n > 0, F.sum(((F.col(group) == name) & F.col("selected")).cast("int")) / n).otherwise(0.0)

    rates = rows.agg(rate(a).alias("ra"), rate(b).alias("rb"))
    ratio = F.when((F.col("ra") == 0) & (F.col("rb") == 0), 1.0).otherwise(F.least("ra", "rb") / F.greatest("ra", "rb"))
    return rates.select(F.round("ra", digits).alias("rate_a"), F.round("rb", digits).alias("rate_b"), F.round(ratio, digits).alias("adverse_impact_ratio"), (ratio >= threshold).alias("passes"), risk_level(ratio).alias("risk_level"))


def score_distribution(rows: DataFrame, digits: int = 4) -> DataFrame:
    """One row (mean, std, median, min, max), std of the population."""
    rest = rows.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    both = rest.crossJoin(F.broadcast(threshold_interpolated(rows, 0.5).withColumnRenamed("threshold", "median")))  # one row each
    return both.select(*[F.round(c, digits).alias(c) for c in ("mean", "std", "median", "min", "max")])


def mann_whitney(rows: DataFrame, a: str, b: str, group: str = "group") -> DataFrame:
    """One row (n_a, n_b, u_a, ties): U of group a with ties counted half, and the sum of t**3 - t over ties.

    Counts by distinct score are placed in sorted ranges; no task sees all scores."""
    two = rows.filter(F.col(group).isin(a, b))
    counts = two.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum((F.col(group) == a).cast("long")).alias("na"), F.sum((F.col(group) == b).cast("long")).alias("label"))
    placed = global_ranks(counts, F.asc("score"))
    t = F.col("na") + F.col("label")
    return placed.agg(F.coalesce(F.sum("na"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("na") * (F.col("hits") - F.col("label") / 2)), F.lit(0.0)).alias("u_a"), F.coalesce(F.sum(t * t * t - t), F.lit(0)).cast("double").alias("ties"))


def p_value(n_a: int, n_b: int, u_a: float, ties: float) -> float:
    """Two-sided: exact for samples of which one has up to 8 rows and none are tied, else normal with both corrections."""
    if not n_a or not n_b:
        return 1.0
    if min(n_a, n_b) <= 8 and not ties:
        ways = {(0, 0): [1]}
        for i in range(n_a + 1):
            for j in range(n_b + 1):
                if i or j:
                    row = [0] * (i * j + 1)
                    for u, w in enumerate(ways.get((i - 1, j), []) if i else []):
                        row[u + j] += w
                    for u, w in enumerate(ways.get((i, j - 1), []) if j else []):
                        row[u] += w
                    ways[i, j] = row
        table = ways[n_a, n_b]
        high = max(u_a, n_a * n_b - u_a)
        return min(1.0, 2 * sum(table[math.ceil(high - 1e-9) :]) / sum(table))
    n = n_a + n_b
    variance = n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = max(0.0, abs(u_a - n_a * n_b / 2) - 0.5) / math.sqrt(variance)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def audit(resumes: DataFrame, scores: DataFrame, threshold: float | None = None, impact: float = 0.8, groups: tuple[str, str] = ("male", "female"), id_col: str = "resume_id") -> dict:
    """The whole audit: small DataFrames by name, and a list of recommendations.

    resumes: (id, text) or (id, group); scores: (id, score). The default threshold is the median of all scores, those of
    ids without a resume included; groups are counted over ids that have both."""
    a, b = groups
    if "group" not in resumes.columns:
        resumes = resumes.select(id_col, group_proxy(F.col("text")).alias("group"))
    rows = select_rows(scores, threshold).join(resumes.select(id_col, "group"), id_col)
    impact_row = adverse_impact(rows, a, b, threshold=impact)
    test = mann_whitney(rows, a, b)
    found = {"group_distribution": group_distribution(rows), "adverse_impact": impact_row, "score_distribution": score_distribution(scores), "mann_whitney": test}
    says: list[str] = []
    counted = test.first()
    if counted["n_a"] and counted["n_b"]:
        air = impact_row.first()
        if not air["passes"]:
            says.append(f"{a} and {b} are selected at rates whose ratio is {air['adverse_impact_ratio']:.2f}; {impact:.2f} is asked for.")
    p = None
    if counted["n_a"] >= 5 and counted["n_b"] >= 5:
        p = round(p_value(*counted), 6)
        if p < 0.05:
            says.append(f"The scores of {a} and {b} are unlikely to be alike (p={p:.4f}).")
    return found | {"p_value": p, "recommendations": says or ["No difference between the groups was found."]}
