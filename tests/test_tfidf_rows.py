"""TF-IDF inside a document's row: what is shuffled, and ids that repeat."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textmill import queries
from textmill.operators import inverted, ltr, tfidf

ROWS = [(1, "sun moon sun"), (2, "moon star"), (3, None), (1, "star sun x"), (None, "sun"), (None, "sun moon"), (4, "sea sea moon")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_hand(rows):
    tf = defaultdict(Counter)
    for i, t in rows:
        tf[i].update(w for w in (t or "").split() if len(w) > 1)
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for i, c in tf.items():
        raw = {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out[i] = {w: x / size for w, x in raw.items()}
    return out


def test_repeated_and_null_ids_add_up(spark):
    docs, want = spark.createDataFrame(ROWS, "id long, text string"), by_hand(ROWS)
    vocabulary = tfidf.fitted(docs, stop_words=[])
    got = {(r.id, r.term): r.weight for r in tfidf.transform(docs, vocabulary, stop_words=[]).collect()}
    assert got == pytest.approx({(i, w): x for i, ws in want.items() for w, x in ws.items()})
    terms = sorted({w for ws in want.values() for w in ws})
    found = tfidf.vectors(docs, vocabulary, stop_words=[]).collect()
    assert sorted(str(r.id) for r in found) == sorted(map(str, want))
    assert all({terms[x.at]: x.weight for x in r.vector} == pytest.approx(want[r.id]) for r in found)


def test_terms_of_single_ids_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "sun moon sun"), (2, "moon star")], "id long, text string")
    vocabulary = tfidf.fitted(docs, stop_words=[])
    for rows in (tfidf.term_frequencies(docs, stop_words=[]), tfidf.transform(docs, vocabulary, stop_words=[]), tfidf.vectors(docs, vocabulary, stop_words=[])):
        assert not any(x in plan(rows) for x in ("Aggregate", "Window", "Join"))


def test_nearest_and_pair_scores_equal_the_join_on_terms(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 9))) for i in range(60)], "id long, text string")
    vocabulary = tfidf.fitted(docs, stop_words=[])
    left, right = (tfidf.vectors(x, vocabulary, stop_words=[]) for x in (docs.filter("id % 6 = 2"), docs))
    long = tfidf.transform(docs, vocabulary, stop_words=[])
    sims = {(r.job_id, r.resume_id): r.score for r in tfidf.similarities(long.filter("id % 6 = 2"), long).collect()}
    best = tfidf.nearest(left, right, vocabulary.count(), 4)
    assert not any(x in plan(best) for x in ("Join", "Aggregate"))  # no row for each pair or shared term
    want = {(j, r) for j in {j for j, _ in sims} for _, r in sorted((-round(s, 9), r) for (q, r), s in sims.items() if q == j)[:4]}
    assert {(r.job_id, r.resume_id) for r in best.collect()} == want
    pairs = spark.createDataFrame([(2, 5), (2, 5), (8, 0), (8, 999), (None, 3), (14, 14)], "job_id long, resume_id long")
    scored = tfidf.pair_scores(pairs, left, right)
    assert "Aggregate" not in plan(scored)
    assert sorted((str(r.job_id), r.resume_id, round(r.score, 9)) for r in scored.collect()) == sorted((str(j), r, round(sims.get((j, r), 0.0), 9)) for j, r in [(2, 5), (2, 5), (8, 0), (8, 999), (None, 3), (14, 14)])


def test_scores_join_features_before_words_do(spark):
    sides = [spark.createDataFrame([(1, "red sun", [1.0, 0.0], ["a"])], f"{k} long, text string, vector array<double>, skills array<string>") for k in ("job_id", "resume_id")]
    pairs = spark.createDataFrame([(1, 1)], "job_id long, resume_id long")
    rows = ltr.features(pairs, *sides, pairs.withColumn("score", F.lit(0.5)))
    assert rows.first().tfidf_similarity == 0.5
    first = next(x for x in plan(rows).splitlines() if "Join" in x)
    assert "job_id" not in first  # the last step, of the widest rows, is not the join with scores


def test_training_reads_written_features(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.ltr, "train_and_evaluate", lambda rows, ranker: seen.append(rows) or {"scored": rows.withColumn("score", F.lit(0.0))})
    queries.QUERIES["ltr_train_predict"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(seen[0]) and seen[0].count() > 0
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert {r.resume_id for r in seen[0].select("resume_id").collect()} <= {r.doc_id for r in labels.collect()}


def test_index_and_queries_by_block_leave_postings_in_place(spark):
    docs = [(i, f"w{(i * 5 + j * j) % 17}", 0.1 + (i * j) % 7) for i in range(80) for j in range(i % 6 + 1)]
    weights = spark.createDataFrame(list({(i, w): (i, w, x) for i, w, x in docs}.values()), "id long, term string, weight double")
    sized = weights.join(weights.groupBy("id").agg(F.count("*").alias("n_terms")), "id")
    rows = lambda df: sorted(map(tuple, df.select("term", "block", "id", "weight").collect()))
    assert rows(inverted.index(sized)) == rows(postings := inverted.index(weights))
    queries = spark.createDataFrame([(q, f"w{(q * 3 + t) % 17}", 1.0 + t) for q in range(7) for t in range(4)], "q long, term string, w double")
    one = inverted.top_products(queries, postings, 5, probe=2)
    many = inverted.top_products(queries, postings, 5, probe=2, block=2)
    pick = lambda df: sorted((r.q, r.id, r.rank, round(r.score, 9)) for r in df.collect())
    assert pick(one) == pick(many) and len(pick(one)) == 35
    want = sorted((-round(sum(w * x for _, t, w in queries.collect() if _ == 3 for i, u, x in weights.collect() if u == t and i == d), 9), d) for d in range(80))[:5]
    assert [(-s, d) for q, d, _, s in sorted(pick(one), key=lambda r: r[2]) if q == 3] == want
