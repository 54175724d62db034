"""Driver-sized conveniences: single texts and short lists, through the same expressions as whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sections, text
from .operators import fairness, metrics

_LISTS = "query_id string, pos int, score double, label int"


def on_text(spark: SparkSession, value: str | None, fn: Callable[[Column], Column]):
    """fn of one text, such as functions.text.normalize_text."""
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


def normalize_text(spark: SparkSession, value: str | None, **options) -> str:
    return on_text(spark, value, lambda c: text.normalize_text(c, **options))


def parse_document(spark: SparkSession, value: str | None) -> dict[str, dict]:
    """Non-empty sections by name, in order: content, word_count and lines."""
    rows = sections.parsed(spark.createDataFrame([(0, value)], "id int, text string"), "id", "text").collect()
    return {s["section"]: {"content": s["content"], "word_count": s["word_count"], "lines": s["lines"]} for r in rows for s in r["sections"]}


def weighted_text(spark: SparkSession, value: str | None, weights: dict[str, float] | None = None) -> str:
    frame = spark.createDataFrame([(0, value)], "id int, text string")
    return sections.weighted_text(frame, "id", "text", weights or sections.SECTION_WEIGHTS).first()["weighted"]


def detect_group(spark: SparkSession, value: str | None) -> str:
    return on_text(spark, value, fairness.group_proxy)


def _named(row: dict, k_values: tuple[int, ...], average: str) -> dict[str, float]:
    out = {f"{name}@{k}": round(row[f"{key}_at_{k}"], 4) for k in k_values for name, key in (("P", "p"), ("R", "r"), ("NDCG", "ndcg"))}
    return out | {"MRR": round(row["mrr"], 4), average: round(row["ap" if average == "AP" else "map"], 4), "ROC-AUC": round(row["roc_auc"], 4)}


def quick_evaluate(spark: SparkSession, y_true: list[int], y_scores: list[float], k_values: tuple[int, ...] = (1, 3, 5, 10)) -> dict[str, float]:
    """Metrics of one list, to 4 places."""
    rows = [("all", i, float(s), int(y)) for i, (y, s) in enumerate(zip(y_true, y_scores, strict=True))]
    return _named(metrics.flat(spark.createDataFrame(rows, _LISTS), k_values).first().asDict(), k_values, "AP")


class RankingEvaluator:
    """Gathers short lists by query and evaluates them together."""

    def __init__(self, spark: SparkSession, k_values: tuple[int, ...] = (1, 3, 5, 10)):
        self.spark, self.k_values, self.queries = spark, k_values, {}

    def add_query(self, query_id: str, y_true: list[int], y_scores: list[float]) -> None:
        """A query that is added again replaces its list."""
        self.queries[str(query_id)] = list(zip(map(int, y_true), map(float, y_scores), strict=True))

    def _frame(self) -> DataFrame:
        return self.spark.createDataFrame([(q, i, s, y) for q, rows in self.queries.items() for i, (y, s) in enumerate(rows)], _LISTS)

    def to_dataframe(self) -> DataFrame:
        return metrics.per_query(self._frame(), self.k_values)

    def compute_all(self) -> dict:
        """{aggregate, num_queries, per_query}; without queries {}."""
        if not self.queries:
            return {}
        each = {r["query_id"]: r.asDict() for r in self.to_dataframe().collect()}
        return {"aggregate": _named(metrics.aggregate(self._frame(), self.k_values).first().asDict(), self.k_values, "MAP"), "num_queries": len(each), "per_query": each}

    def report(self) -> str:
        from .plans.reports import lines

        return lines("Ranking evaluation", self.compute_all().get("aggregate", {}))
