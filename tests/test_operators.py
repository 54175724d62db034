import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from textmill.functions.vectors import HashingEncoder
from textmill.operators import cache, explain, fairness, labeling, ltr, pairs, ranking, search, tfidf
from textmill.plans import pipeline, reports, service, tracking
from textmill.sources import readers, sinks
from textmill.streaming import text as stream


def test_first_match_order(spark):
    jobs = spark.createDataFrame([(1, "Senior Data Engineer"), (2, "Chef"), (3, None)], "job_id long, title string")
    domains = [("it", ["data"]), ("build", ["engineer"])]
    assert [(r.job_id, r.assigned_domain) for r in labeling.label_domains(jobs, domains).collect()] == [(1, "it")]


def test_balanced_sample(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3)
    got = labeling.balanced_sample(rows, "g", "id", 10)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {0: 10, 1: 10, 2: 10}
    assert got.exceptAll(labeling.balanced_sample(rows.repartition(5), "g", "id", 10)).isEmpty()


def test_domain_pairs(spark):
    jobs = spark.createDataFrame([(i, "abx"[i % 3]) for i in range(9)], "job_id long, domain string")
    resumes = spark.createDataFrame([(f"r{i}", "abc"[i % 3]) for i in range(12)], "resume_id string, domain string")
    rows = pairs.domain_pairs(jobs, resumes).collect()
    assert all((r.jd_domain == r.resume_domain) == bool(r.label) for r in rows)
    per_job = {j: [r.label for r in rows if r.job_id == j] for j in range(9)}
    assert all(sorted(v) == ([] if j % 3 == 2 else [0, 0, 0, 1]) for j, v in per_job.items())
    assert len({(r.job_id, r.resume_id) for r in rows}) == len(rows)


def test_extremes_and_zeros(spark):
    scored = spark.createDataFrame([(1, 5, 0.5), (1, 7, 0.9)], "job_id long, resume_id long, score double")
    jobs, resumes = spark.createDataFrame([(1,), (2,)], "job_id long"), spark.range(10).withColumnRenamed("id", "resume_id")
    got = pairs.extremes(pairs.with_zeros(scored, jobs, resumes, 3), 3)
    have = {(r.job_id, r.label): sorted(x.resume_id for x in got.collect() if (x.job_id, x.label) == (r.job_id, r.label)) for r in got.collect()}
    assert have == {(1, 1): [5, 7, 9], (1, 0): [0, 1, 2], (2, 1): [7, 8, 9], (2, 0): [0, 1, 2]}


@pytest.mark.parametrize("share", [0.0, 0.5, 0.97])
def test_zeros_are_all_that_extremes_need(spark, share):
    rng = random.Random(3)
    ids = [f"r{i:04d}" for i in range(700)]
    rows = [(j, i, rng.choice([0.1, 0.2, 0.3])) for j in range(4) for i in ids if rng.random() < (share if j else 1.0)]
    scored = spark.createDataFrame(rows, "job_id long, resume_id string, score double")
    jobs, resumes = spark.range(5).withColumnRenamed("id", "job_id"), spark.createDataFrame([(i,) for i in ids], "resume_id string")
    full = pairs.with_zeros(scored, jobs, resumes, 5)
    got = {(r.job_id, r.resume_id, r.label) for r in pairs.extremes(full, 5).collect()}
    have = {(j, i): s for j, i, s in rows}
    want = set()
    for j in range(5):
        order = sorted((have.get((j, i), 0.0), i) for i in ids)
        want |= {(j, i, 0) for _, i in order[:5]} | {(j, i, 1) for _, i in order[-5:]}
    assert got == want and full.count() <= len(rows) + 5 * 2 * 2 * 128


def test_search_against_brute_force(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(300)] + [(300, None), (301, [])]
    frame = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(5)
    q, c = frame.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), frame.withColumnRenamed("id", "doc_id")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a or [])) * math.sqrt(sum(x * x for x in b or []))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    for largest, block in ((True, 2048), (False, 2048), (True, 4)):
        got = {(r.query_id, r["rank"]): r for r in search.nearest(q, c, 7, largest=largest, different=True, block=block).collect()}
        for i, v in vectors[::20]:
            order = sorted(((round(-cosine(v, w) if largest else cosine(v, w), 9), j) for j, w in vectors if j != i))[:7]
            assert [round(got[i, r].score, 9) for r in range(1, 8)] == [(-s if largest else s) + 0.0 for s, _ in order]
            assert all(got[i, r].total_candidates == 301 for r in range(1, 8))
    every = search.cross_scores(q, c, block=5).collect()
    assert len(every) == 16 * 302 and all(abs(r.score - cosine(dict(vectors)[r.query_id], dict(vectors)[r.doc_id])) < 1e-9 for r in every)
    assert search.nearest(q.limit(0), c, 3).count() == 0


def test_skill_pairs_against_brute_force(spark):
    js = {1: {"a", "b"}, 2: {"c"}, 3: {"a", "b", "c", "d"}}
    rs = {i: set(itertools.islice(itertools.cycle("abcdef"), i, i + 1 + i % 3)) for i in range(12)}
    j = spark.createDataFrame([(k, sorted(v)) for k, v in js.items()], "job_id long, skills array<string>")
    r = spark.createDataFrame([(k, sorted(v)) for k, v in rs.items()], "resume_id long, skills array<string>")
    got = {(x.job_id, x.resume_id, x.label) for x in pairs.skill_pairs(j, r, 4).collect()}
    want = set()
    for k, need in js.items():
        order = sorted((len(need & have) / len(need), i) for i, have in rs.items())
        want |= {(k, i, 0) for _, i in order[:4]} | {(k, i, 1) for _, i in order[-4:]}
    assert got == want


def test_split_keeps_queries_whole(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("query_id"), "id")
    flags = pairs.split_queries(rows, test_share=0.2).groupBy("query_id").agg(F.countDistinct("is_train").alias("n"), F.max("is_train").alias("t")).collect()
    assert len(flags) == 10 and all(r.n == 1 for r in flags) and sum(r.t for r in flags) == 8


def test_tfidf_of_ubiquitous_term(spark):
    docs = spark.createDataFrame([("a", "sun moon"), ("b", "sun"), ("c", None)], "id string, text string")
    vocabulary = tfidf.fit(docs, stop_words=[])
    vectors = tfidf.transform(docs, vocabulary, stop_words=[])
    assert {r.id for r in vectors.collect()} == {"a", "b"}
    assert vectors.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).filter(F.abs(F.col("n") - 1) > 1e-9).isEmpty()
    assert tfidf.fit(docs, max_terms=1, stop_words=[]).first().term == "sun"


def test_ranking(spark):
    scored = spark.createDataFrame([("q", d, s) for d, s in [("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.1)]], "query_id string, doc_id string, score double")
    assert [(r.doc_id, r.rank, r.total_candidates) for r in ranking.top_k(scored, 3).orderBy("rank").collect()] == [("b", 1, 4), ("a", 2, 4), ("c", 3, 4)]
    assert ranking.top_k(scored, None).count() == 4
    texts = scored.select("query_id", "doc_id", F.lit("q").alias("query_text"), F.when(F.col("doc_id") == "a", "").otherwise(F.col("doc_id")).alias("doc_text"))
    got = ranking.rerank(scored, texts, lambda ps: [ord(d) for _, d in ps], depth=3)
    order = [(r.doc_id, r.stage) for r in got.orderBy("stage", F.desc("score")).collect()]
    assert order == [("c", 1), ("b", 1), ("d", 2)]
    blank = texts.withColumn("doc_text", F.lit(""))
    assert ranking.rerank(scored, blank, F.lit(1.0), depth=3).count() == 4


def test_plan_cuts_groups_before_the_shuffle(spark):
    scored = spark.range(100).select((F.col("id") % 5).alias("query_id"), F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    plan = ranking.bottom_k(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_rank_texts_and_service(spark):
    resumes = spark.createDataFrame([("a", "python sql"), ("b", "cooking"), ("c", None)], "resume_id string, text string")
    got = service.rank(spark, "python sql", resumes, 2)
    assert [r["rank"] for r in got] == [1, 2] and got[0]["resume_id"] == "a" and got[0]["score"] == 1.0 and got[0]["total_candidates"] == 3
    with pytest.raises(service.BadRequest):
        service.rank(spark, " ", resumes)
    found = service.explain_match(spark, "We need python and sql", "python only", ["python", "sql"])
    assert found["skill_analysis"]["missing_skills"] == ["sql"] and found["skill_analysis"]["match_ratio"] == "1/2"
    up = service.upload_pdf(spark, "x.PDF", b"ignored", lambda b: ["mail a@b.c", "page two"])
    assert up["text"] == "mail [email]\npage two" and up["pages"] == 2
    with pytest.raises(service.BadRequest):
        service.upload_pdf(spark, "x.txt", b"")
    with pytest.raises(service.BadRequest):
        service.upload_pdf(spark, "x.pdf", b"", lambda b: [""])
    assert service.stats({"r": resumes}) == {"r": 3} and service.health() == {"status": "ok"}


def test_explanations(spark):
    rows = [("j", "r", "We need Python, SQL and docker", "Python and Java developer; SQL", ["python", "sql", "kafka"], 0.4, 1), ("j", "s", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "job_id string, resume_id string, job_text string, resume_text string, job_skills array<string>, similarity double, label int")
    got = {r.resume_id: r for r in explain.explain(frame).collect()}
    a = got["r"].skill_analysis
    assert a.matched_skills == ["python", "sql"] and a.missing_skills == ["kafka"] and a.extra_skills == ["java"] and a.coverage == 0.667
    assert got["r"].level == "STRONG" and "lacks: kafka" in got["r"].verdict and got["r"].true_label == 1
    assert got["s"].level == "WEAK" and got["s"].keyword_overlap.overlap_ratio == 0.0
    assert "python" in explain.skill_vocabulary(spark.createDataFrame([(" Welding ",)], "skill_name string")) and "STRONG" in explain.format_explanation(got["r"])


@pytest.mark.parametrize(("text", "want"), [("He led his team; him they trusted", "male"), ("She and her mother", "female"), ("he and she", "unknown"), ("Priya\nEngineer", "female"), ("\nJohn", "unknown"), (None, "unknown")])
def test_group_proxy(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fairness.group_proxy(F.col("t"))).first()[0] == want


def test_adverse_impact(spark):
    def rows(a, b):
        return spark.createDataFrame([("male", 0.5, i < a) for i in range(50)] + [("female", 0.5, i < b) for i in range(50)], "group string, score double, selected boolean")

    good, bad, none = (fairness.adverse_impact(rows(*x), "male", "female").first() for x in ((40, 38), (40, 10), (0, 0)))
    assert good.passes and good.adverse_impact_ratio == 0.95 and good.risk_level == "LOW"
    assert not bad.passes and bad.risk_level == "CRITICAL" and none.adverse_impact_ratio == 1.0


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_mann_whitney(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0, 4.0], [2.0, 3.0, 3.0, 8.0, 8.5]
    frame = spark.createDataFrame([("m", x) for x in a] + [("f", x) for x in b], "group string, score double")
    row = fairness.mann_whitney(frame, "m", "f").first()
    assert (row.n_a, row.n_b, row.u_a) == (6, 5, brute_u(a, b)) and row.ties == 24 + 6
    exact = fairness.p_value(3, 3, 9, 0)
    splits = list(itertools.combinations(range(6), 3))
    want = sum(abs(brute_u(s, [x for x in range(6) if x not in s]) - 4.5) >= 4.5 for s in splits) / len(splits)
    assert exact == pytest.approx(want) and fairness.p_value(0, 3, 0, 0) == 1.0


def test_audit(spark):
    resumes = spark.createDataFrame([(i, "He his him" if i % 2 else "She her hers") for i in range(40)], "resume_id long, text string")
    scores = spark.createDataFrame([(i, float(i % 2) + i / 1000) for i in range(50)], "resume_id long, score double")
    found = fairness.audit(resumes, scores)
    assert len(found["recommendations"]) == 2 and found["p_value"] < 0.05
    assert "selected at rates" in reports.audit_report(found)


def test_learning_to_rank(spark):
    words = ["red", "blue", "green", "gold"]
    jobs = spark.createDataFrame([(i, words[i % 4] + " alpha", [1.0, i % 4 + 0.0], [words[i % 4]]) for i in range(20)], "job_id long, text string, vector array<float>, skills array<string>")
    resumes = spark.createDataFrame([(i, words[i % 4] + " beta gamma", [1.0, i % 4 + 0.0], [words[i % 4]]) for i in range(12)], "resume_id long, text string, vector array<float>, skills array<string>")
    label = jobs.select("job_id").crossJoin(resumes.select("resume_id")).withColumn("label", (F.col("job_id") % 4 == F.col("resume_id") % 4).cast("int"))
    rows = ltr.features(label, jobs, resumes)
    assert set(ltr.FEATURES) <= set(rows.columns) and rows.count() == 240
    with pytest.raises(RuntimeError):
        ltr.Ranker().predict(rows)
    done = ltr.train_and_evaluate(rows, ltr.Ranker(trees=3, depth=2))
    assert done["evaluation"]["flat"].first().roc_auc > 0.95 and done["scored"].filter("score < 0 or score > 1").isEmpty()
    assert sum(v for _, v in done["importances"]) == pytest.approx(1.0)


def test_cache_computes_each_text_once(spark, tmp_path):
    class Counting(HashingEncoder):
        pass

    store = cache.VectorCache(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    assert store.encode(docs, Counting(8), "id", "text").count() == 3
    assert store.stats() == {"hashing-8": 2}
    store.encode(docs, Counting(8), "id", "text").count()
    assert store.stats() == {"hashing-8": 2}
    store.clear()
    assert store.stats() == {}


def test_tracking(spark, tmp_path):
    seen = []
    t = tracking.Tracker(spark, "e", str(tmp_path / "runs"), seen.append)
    t.run("low", lambda p: {"flat": {"ROC-AUC": 0.5, "n": True}}, {"a": 1})
    t.run("high", lambda p: {"flat": {"ROC-AUC": 0.9}})
    t.run("none", lambda p: {"note": "x"})
    with pytest.raises(ZeroDivisionError):
        t.run("bad", lambda p: 1 / 0)
    assert [r.run_name for r in t.compare().orderBy("place").collect()] == ["high", "low"] and t.list_runs().count() == 4 and len(seen) == 4
    assert "high" in reports.leaderboard_report(t.compare())


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Resume_str,Category\n"line one\nline ""two""",IT\n,HR\n')
    rows = readers.resume_csv(spark, str(tmp_path / "r.csv")).collect()
    assert sorted(r.text for r in rows) == ["", 'line one\nline "two"']
    with pytest.raises(readers.MissingColumn):
        readers.resume_csv(spark, str(tmp_path / "r.csv"), "Text")
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.txt").write_text("x\ny")
    (folder / "b.md").write_text("no")
    assert [(r.resume_id, r.text) for r in readers.text_directory(spark, str(folder)).collect()] == [("a.txt", "x\ny")]
    pdf = tmp_path / "p" / "it"
    pdf.mkdir(parents=True)
    (pdf / "1.PDF").write_bytes(b"good")
    (pdf / "2.pdf").write_bytes(b"bad")

    def pages(b):
        if b == b"bad":
            raise ValueError("broken")
        return ["one ", "two"]

    got = {r.resume_id: r for r in readers.pdf_directory(spark, str(tmp_path / "p"), pages_of=pages).collect()}
    assert got["it_1.txt"].text == "one two" and got["it_1.txt"].domain == "it" and "broken" in got["it_2.txt"].error
    assert [r.resume_filename for r in readers.pdf_listing(spark, str(tmp_path / "p")).collect()] == ["2.pdf"]
    with pytest.raises(ValueError):
        sinks.corpus(spark.createDataFrame([("a",), ("a",)], "resume_id string"), str(tmp_path / "out"))


def test_stream_equals_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Senior• Dev a@b.cc"), (2, None)], "id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream.normalize_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("normalised").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("normalised").collect())) == sorted(map(tuple, stream.normalize_stream(docs).collect()))


def test_staged_run(spark, tmp_path, capsys):
    data, out = tmp_path / "data", str(tmp_path / "out")
    data.mkdir()
    (data / "domains.json").write_text(json.dumps({"it": ["data"], "food": ["cook"]}))
    (data / "jobs.csv").write_text("job_id,title,description\n" + "".join(f"{i},{'Data' if i % 2 else 'Cook'} lead,need {'sql' if i % 2 else 'knife'} skills\n" for i in range(8)))
    (data / "resumes.csv").write_text("resume_id,domain,text\n" + "".join(f"r{i},{'it' if i % 2 else 'food'},he his {'sql data' if i % 2 else 'knife work'} {i}\n" for i in range(14)))
    (data / "skills.csv").write_text("skill_abr,skill_name\nS,Sql\nK,Knife\n")
    (data / "job_skills.csv").write_text("job_id,skill_abr\n" + "".join(f"{i},{'S' if i % 2 else 'K'}\n" for i in range(8)))
    results = pipeline.run_all(spark, str(data), out) + [pipeline.run_stage(spark, s, str(data), out) for s in ("explain", "fairness")]
    assert all(r["error"] is None for r in results), results
    assert spark.read.parquet(f"{out}/metrics/skill/flat").first().roc_auc > 0.9
    assert pipeline.run_stage(spark, "ingestion", str(tmp_path / "none"), out)["error"]
    assert pipeline.main(["--list"]) == 0 and "fairness" in capsys.readouterr().out
