"""Searches that skip work against brute force: results are the same, and most of the work is not done."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import cells, inverted

VECTOR = "vector array<double>"


def nearest_by_hand(queries, candidates, k, largest, different):
    out = {}
    norm = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0) if v else None
    for q, v in dict(reversed(queries)).items():
        a = norm(v)
        rows = [(round(float((a * norm(w)).sum()), 9) + 0.0 if v and w else 0.0, d) for d, w in candidates if d is not None and not (different and d == q)]
        rows.sort(key=lambda r: (-r[0] if largest else r[0], r[1]))
        out[q] = [(d, s) for s, d in rows[:k]], len(rows)
    return out


def clustered(n, seed=3, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(i, (centres[i % 12] + 0.05 * rng.normal(size=width)).tolist()) for i in range(n)]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, ([], r.total_candidates))[0].append((r.doc_id, round(r.score, 9) + 0.0))
    return out


@pytest.mark.parametrize(("largest", "different", "rows"), [(True, True, 16_384), (False, False, 16_384), (True, False, 7)])
def test_cells_equal_all_products(spark, largest, different, rows, monkeypatch):
    monkeypatch.setattr(cells, "QUERIES", 25)  # so that queries come in several blocks, too
    data = clustered(400)
    data += [(500 + i, data[5][1]) for i in range(40)]  # copies, which no pivot parts: ties by id
    data += [(600, None), (601, []), (602, [0.0] * 8), (None, [1.0] * 8), (7, data[9][1]), (7, data[9][1])]
    queries = [r for r in data if r[0] is not None and (r[0] % 9 == 0 or r[0] >= 600)]
    c = spark.createDataFrame(data, f"doc_id long, {VECTOR}").withColumn("cell", F.lit("x")).repartition(3)
    q = spark.createDataFrame(queries, f"query_id long, {VECTOR}")
    got = cells.nearest_by_cells(q, c, 6, largest=largest, different=different, rows=rows)
    assert found(got) == nearest_by_hand(queries, data, 6, largest, different)


def test_cells_compare_few(spark):
    data = clustered(3000)
    c = spark.createDataFrame(data, f"doc_id long, {VECTOR}")
    q = c.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = cells.nearest_by_cells(q, c, 5, different=True)
    assert found(got) == nearest_by_hand([r for r in data if r[0] % 20 == 0], data, 5, True, True)
    compared = got.groupBy("query_id").agg(F.max("compared").alias("n")).agg(F.sum("n")).first()[0]
    assert compared < 0.2 * 150 * 3000


def test_cells_of_odd_tables(spark):
    data = clustered(30)
    c = spark.createDataFrame(data, f"doc_id long, {VECTOR}")
    q = c.withColumnRenamed("doc_id", "query_id")
    assert cells.nearest_by_cells(q.limit(0), c, 3).count() == 0 and cells.nearest_by_cells(q, c.limit(0), 3).count() == 0
    assert found(cells.nearest_by_cells(q, c, 50)) == nearest_by_hand(data, data, 50, True, False)
    none = c.withColumn("vector", F.lit(None).cast("array<double>"))
    assert cells.nearest_by_cells(q, none, 2).filter("score = 0 and doc_id < 2").count() == 60
    with pytest.raises(Exception, match="other lengths"):
        cells.nearest_by_cells(q, c.union(spark.createDataFrame([(99, [1.0])], c.schema)), 2).collect()


def sparse_corpus(seed, docs=250, queries=12, natural=False):
    """Documents of 3 to 80 terms of very unequal frequency, as unit vectors; some documents contain a query."""
    rng = np.random.default_rng(seed)
    terms = [f"t{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    share /= share.sum()
    bags = [dict(zip(*np.unique(rng.choice(terms, int(rng.integers(3, 80)), p=share), return_counts=True), strict=True)) for _ in range(docs)]
    asked = [dict(zip(*np.unique(rng.choice(terms, 25, p=share if natural else None), return_counts=True), strict=True)) for _ in range(queries)]
    for i, q in enumerate(asked):
        for j in range(i % 4 * 5):
            bags[(i * 17 + j) % docs] = dict(bags[(i * 17 + j) % docs]) | {t: c + j % 3 for t, c in q.items()}
    scale = {t: 1 - np.log(p) for t, p in zip(terms, share, strict=True)}

    def rows(sets):
        out = []
        for i, b in enumerate(sets):
            length = np.sqrt(sum((c * scale[t]) ** 2 for t, c in b.items()))
            out += [(i, str(t), float(c * scale[t] / length)) for t, c in b.items()]
        return out

    return rows(asked), rows(bags)


def top_by_hand(queries, docs, k):
    out = {}
    vectors = {}
    for i, t, w in docs:
        vectors.setdefault(i, {})[t] = w
    asked = {}
    for q, t, w in queries:
        asked.setdefault(q, {})[t] = asked.get(q, {}).get(t, 0) + w
    for q, a in asked.items():
        scores = [(round(sum(w * v.get(t, 0) for t, w in a.items()), 9), i) for i, v in vectors.items()]
        out[q] = [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1])) if s > 0][:k]
    return {q: rows for q, rows in out.items() if rows}


def top_rows(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.id, round(r.score, 9)))
    return out


@pytest.mark.parametrize(("seed", "k", "probe"), [(0, 5, 64), (1, 10, 2), (2, 400, 64), (3, 1, 1)])
def test_index_equals_all_products(spark, seed, k, probe):
    queries, docs = sparse_corpus(seed)
    docs += [(1000 + i, t, w) for i in range(30) for j, t, w in docs if j == 17]  # copies: ties by id
    queries += [(50, "unknown", 1.0), (51, "t0", 0.5), (51, "t0", 0.5)]
    postings = inverted.index(spark.createDataFrame(docs, "id long, term string, weight double").withColumn("block", F.lit("x")))
    got = inverted.top_products(spark.createDataFrame(queries, "q long, term string, w double"), postings, k, probe)
    assert top_rows(got) == top_by_hand(queries, docs, k)


def test_index_reads_a_part(spark):
    """How much is skipped depends on the floor, which near copies of each query raise here."""
    queries, docs = sparse_corpus(5, docs=4000, natural=True)
    docs += [(5000 + 10 * q + j, t, w) for j in range(6) for q, t, w in queries if (hash_of(t) + j) % 17]
    postings = inverted.index(spark.createDataFrame(docs, "id long, term string, weight double"))
    got = inverted.top_products(spark.createDataFrame(queries, "q long, term string, w double"), postings, 5)
    assert top_rows(got) == top_by_hand(queries, docs, 5)
    read, whole = got.groupBy("q").agg(F.max("read").alias("r"), F.max("postings").alias("p")).agg(F.sum("r"), F.sum("p")).first()
    assert read < 0.6 * whole
    assert inverted.top_products(spark.createDataFrame(queries, "q long, term string, w double").limit(0), postings, 5).count() == 0


def hash_of(term):
    return int(term[1:]) * 7
