import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textmill.operators import metrics


def frame(spark, labels, scores, query="q"):
    return spark.createDataFrame([(query, i, float(s), int(y)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))], "query_id string, pos int, score double, label int")


def test_goldens(spark):
    row = metrics.per_query(frame(spark, [1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5]), (1, 2, 3)).first()
    assert (row.p_at_1, row.p_at_2, row.r_at_1, row.r_at_3) == (1.0, 0.5, 0.5, 1.0)
    assert row.p_at_3 == pytest.approx(2 / 3)
    assert metrics.per_query(frame(spark, [1, 1, 0, 0], [0.9, 0.8, 0.3, 0.1]), (4,)).first().ndcg_at_4 == pytest.approx(1.0)
    assert metrics.per_query(frame(spark, [0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6]), (1,)).first().mrr == 0.5


def test_ties_take_the_later_row_first(spark):
    row = metrics.per_query(frame(spark, [1, 0, 0], [0.5, 0.5, 0.9]), (2,)).first()
    assert row.p_at_2 == 0.0 and row.mrr == pytest.approx(1 / 3)


def test_no_relevant_and_empty(spark):
    row = metrics.per_query(frame(spark, [0, 0], [1, 2])).first()
    assert row.ap == row.mrr == row.r_at_10 == row.ndcg_at_10 == 0.0
    empty = frame(spark, [], [])
    assert metrics.per_query(empty).count() == 0
    assert metrics.roc_auc(empty).first()[0] == 0.0


def brute(labels, scores):
    order = sorted(range(len(labels)), key=lambda i: (-scores[i], -i))
    hits, ap = 0, 0.0
    for rank, i in enumerate(order, 1):
        hits += labels[i]
        ap += labels[i] * hits / rank
    p, n = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else 0.0
    return (ap / hits if hits else 0.0), auc


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=1, max_size=25))
def test_against_brute_force(spark, rows):
    labels, scores = [r[0] for r in rows], [r[1] for r in rows]
    ap, auc = brute(labels, scores)
    data = frame(spark, labels, scores)
    got = metrics.flat(data, (1, 3)).first()
    assert got.ap == pytest.approx(ap) and got.roc_auc == pytest.approx(auc)
    each = metrics.per_query(data, (1, 3)).first()
    for c in ("p_at_1", "p_at_3", "r_at_3", "ndcg_at_3", "mrr", "ap"):
        assert got[c] == pytest.approx(each[c]) and 0 <= got[c] <= 1


def test_aggregate_means(spark):
    both = frame(spark, [1, 0, 1], [0.9, 0.5, 0.7], "q1").union(frame(spark, [0, 1, 0], [0.3, 0.9, 0.4], "q2"))
    row = metrics.aggregate(both, (1, 3)).first()
    assert row.num_queries == 2 and row.map == 1.0 and row.p_at_1 == 1.0


def test_thresholds_and_report(spark):
    data = frame(spark, [0, 0, 1, 1], [1, 2, 3, 4])
    assert metrics.threshold_interpolated(data, 0.5).first()[0] == 2.5
    assert metrics.threshold_element(data, 0.75).first()[0] == 4.0
    assert metrics.threshold_element(data, 0.5).first()[0] == 3.0
    report = {r["class"]: r for r in metrics.classification_report(metrics.classify(data, metrics.threshold_interpolated(data))).collect()}
    assert report["accuracy"].f1 == 1.0 and report["1"].support == 2 and math.isclose(report["macro avg"].recall, 1.0)


def test_evaluate_has_all_parts(spark):
    parts = metrics.evaluate(frame(spark, [1, 0, 1, 0, 1], [0.9, 0.7, 0.8, 0.4, 0.6]))
    assert set(parts) == {"flat", "per_query", "aggregate", "threshold", "report"}
    assert {"p_at_1", "ndcg_at_5", "roc_auc"} <= set(parts["flat"].columns)
