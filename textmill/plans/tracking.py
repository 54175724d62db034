"""Experiment runs as rows: log, list, leaderboard."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import runs


def flatten(values: dict, prefix: str = "") -> dict[str, float]:
    """Numbers of nested dicts by dotted names; other values are left out."""
    out: dict[str, float] = {}
    for k, v in values.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, f"{name}.")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[name] = float(v)
    return out


def leaderboard(rows: DataFrame, metric: str = "flat.ROC-AUC") -> DataFrame:
    """Rows (place, run_name, run_id, value) of the runs that have the metric, best first."""
    have = rows.withColumn("value", F.element_at("metrics", metric)).filter("value is not null")
    by = Window.partitionBy("experiment").orderBy(F.desc("value"), "run_name", "run_id")
    return have.withColumn("place", F.row_number().over(by)).select("experiment", "place", "run_name", "run_id", "value")


class Tracker:
    """Appends a JSON row a run to a folder; `sink` (optional) is called with each row, as a hook for other trackers."""

    def __init__(self, spark: SparkSession, experiment: str, path: str, sink: Callable[[dict], None] | None = None):
        self.spark, self.experiment, self.path, self.sink = spark, experiment, path, sink

    def run(self, name: str, fn: Callable[[dict], dict], params: dict | None = None, tags: dict | None = None) -> dict:
        """Call fn(params) and log its metrics; a failure is logged and raised."""
        began, status, metrics = time.time(), "finished", {}
        started = datetime.now(timezone.utc).isoformat()
        try:
            metrics = fn(params or {})
        except Exception as e:
            status = f"failed: {e}"
            raise
        finally:
            row = {"run_id": uuid.uuid4().hex, "experiment": self.experiment, "run_name": name, "started": started, "elapsed_seconds": time.time() - began, "status": status}
            row |= {"params": {k: str(v) for k, v in (params or {}).items()}, "tags": {k: str(v) for k, v in (tags or {}).items()}, "metrics": flatten(metrics)}
            schema = "run_id string, experiment string, run_name string, started string, elapsed_seconds double, status string, params map<string,string>, tags map<string,string>, metrics map<string,double>"
            self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(self.path)
            if self.sink:
                self.sink(row)
        return metrics

    def list_runs(self) -> DataFrame:
        return runs(self.spark, self.path).filter(F.col("experiment") == self.experiment)

    def compare(self, metric: str = "flat.ROC-AUC") -> DataFrame:
        return leaderboard(self.list_runs(), metric)


def prebuilt(scored: dict[str, DataFrame]) -> dict[str, Callable[[dict], dict]]:
    """Experiments for named scored lists (query_id, doc_id, pos, score, label): each gives the flat and mean metrics."""
    from ..operators.metrics import aggregate, flat

    def of(rows: DataFrame) -> Callable[[dict], dict]:
        def run(_: dict) -> dict:
            one = flat(rows).first().asDict()
            return {"flat": {**one, "ROC-AUC": one["roc_auc"]}, "aggregate": aggregate(rows).first().asDict()}

        return run

    return {name: of(rows) for name, rows in scored.items()}
