"""Small results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

RULE = "=" * 60


def lines(title: str, values: dict) -> str:
    return "\n".join([RULE, title, RULE, *[f"  {k:<28} {v:.4f}" if isinstance(v, float) else f"  {k:<28} {v}" for k, v in values.items()]])


def metric_report(aggregate: DataFrame, title: str = "Ranking evaluation") -> str:
    return lines(title, aggregate.first().asDict())


def audit_report(audit: dict) -> str:
    out = [lines("Adverse impact", audit["adverse_impact"].first().asDict())]
    out += [lines(f"Group {r['group']}", r.asDict()) for r in audit["group_distribution"].orderBy("group").collect()]
    return "\n".join([*out, *audit["recommendations"]])


def leaderboard_report(board: DataFrame, n: int = 20) -> str:
    return "\n".join([RULE, *[f"{r['place']:>3}. {r['run_name']:<30} {r['value']:.4f}" for r in board.limit(n).collect()]])
