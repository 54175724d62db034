"""Quantiles by bits and ranks by segment against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import metrics, quantiles, segments

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, 0.1, 0.1, 0.1 + 2**-56, 3.0]


def test_bits_keep_the_order():
    x = np.array(sorted(ODD))
    bits = quantiles.sortable(x)
    assert (bits[1:] >= bits[:-1]).all() and all(quantiles.from_sortable(int(b)) == v for b, v in zip(bits, x, strict=True))
    nan = np.array([np.nan, -np.nan])
    assert len(set(quantiles.sortable(nan).tolist())) == 1 and quantiles.sortable(nan)[0] > bits.max()


@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_equal_sorted_scores(spark, seed):
    rng = np.random.default_rng(seed)
    scores = [*rng.normal(size=700).tolist(), *[0.25] * 300, *np.round(rng.random(200), 2).tolist(), *(v for v in ODD if math.isfinite(v))]
    df = spark.createDataFrame([(s, "x") for s in scores] + [(None, "x")] * 9, "score double, bin string").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = sorted(scores)
    at = [q * (len(want) - 1) for q in qs]
    by_hand = [want[math.floor(p)] + (want[math.ceil(p)] - want[math.floor(p)]) * (p - math.floor(p)) for p in at]
    assert quantiles.quantiles(df, qs) == by_hand
    assert metrics.threshold_interpolated(df, 0.75).first().threshold == by_hand[4]
    assert metrics.threshold_element(df, 0.75).first().threshold == want[int(len(want) * 0.75)]
    empty = df.limit(0)
    assert quantiles.quantiles(empty, qs) == [None] * 7 and metrics.threshold_element(empty).first().threshold is None


def segments_by_hand(rows, qs):
    groups = collections.defaultdict(list)
    for g, s, y in rows:
        if s is not None:
            groups[g].append((s, int((y or 0) > 0)))
    out = {}
    for g, xs in groups.items():
        pos, neg = [s for s, y in xs if y], [s for s, y in xs if not y]
        u = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        ties = sum(t**3 - t for t in collections.Counter(s for s, _ in xs).values())
        v = sorted(s for s, _ in xs)
        at = [q * (len(v) - 1) for q in qs]
        out[g] = (len(xs), len(pos), len(neg), round(u / (len(pos) * len(neg)) if pos and neg else 0.0, 9), u, float(ties), *[round(v[math.floor(p)] + (v[math.ceil(p)] - v[math.floor(p)]) * (p - math.floor(p)), 9) for p in at])
    return out


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_segments_over_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    names = ["hot"] * 8 + [None, "", "=", "a", "b", "c"]
    rows = [(names[int(rng.integers(len(names)))], float(np.round(rng.normal(), 1)), [0, 1, None, 2][int(rng.integers(4))]) for _ in range(900)]
    rows += [("one", 1.0, 1), ("none", None, 1), ("zeros", -0.0, 1), ("zeros", 0.0, 0), ("hot", None, 1)] + [("same", 2.0, i % 2) for i in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        df = spark.createDataFrame(rows, "g string, score double, label int").withColumns({c: F.lit("x") for c in ("key", "part", "n", "u")})
        got = segments.by_segment(df, "g", quantiles=(0.0, 0.5, 0.9))
        assert {r[0]: (*r[1:4], round(r[4], 9), *r[5:7], *[round(x, 9) for x in r[7:]]) for r in got.collect()} == segments_by_hand(rows, (0.0, 0.5, 0.9))
        assert segments.by_segment(df.limit(0), "g").count() == 0 and "u" in segments.by_segment(df, "g", quantiles=()).columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_nothing_is_kept_on_executors(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("score"), (F.col("id") % 2).alias("label"), F.lit("g").alias("g"))
    assert metrics.roc_auc(df).count() == metrics.threshold_interpolated(df).count() == segments.by_segment(df, "g").count() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
