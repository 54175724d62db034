"""Most and least covered sets against all pairs."""

import random

import pytest

from textmill.operators.containment import covered_ends


def by_hand(jobs, resumes, k):
    out = set()
    for j, need in jobs.items():
        scored = [(len(need & have) / len(need), r) for r, have in resumes.items()] if need else []
        for label, rows in ((1, sorted(scored, reverse=True)[:k]), (0, sorted(scored)[:k])):
            out |= {(j, r, s, label) for s, r in rows}
    return out


def run(spark, jobs, resumes, k, probe=2):
    j = spark.createDataFrame([(i, sorted(s)) for i, s in jobs.items()], "job_id long, skills array<string>")
    r = spark.createDataFrame([(i, sorted(s)) for i, s in resumes.items()], "resume_id long, skills array<string>")
    return covered_ends(j, r, k, probe).collect()


@pytest.mark.parametrize("kind", ["all common", "rare", "mixed", "zipf"])
def test_ends_equal_all_pairs(spark, kind):
    rng = random.Random(kind)
    names = [f"s{i}" for i in range(60)]
    weights = {"all common": [1] * 60, "rare": [1] * 60, "mixed": [1] * 60, "zipf": [1 / (i + 1) for i in range(60)]}[kind]
    size = {"all common": (25, 60), "rare": (0, 3), "mixed": (0, 40), "zipf": (0, 30)}[kind]
    resumes = {i: set(rng.choices(names, weights, k=rng.randint(*size))) for i in range(700)}
    jobs = {1: set(names), 2: {"s0"}, 3: {"s1", "s2", "none"}, 4: {"none"}, 5: set(), 6: set(names[:30]), 7: set(names[30:])}
    for k in (1, 4):
        got = run(spark, jobs, resumes, k)
        assert {(r.job_id, r.resume_id, r.score, r.label) for r in got} == by_hand(jobs, resumes, k)
        assert len(got) == len({(r.job_id, r.resume_id, r.label) for r in got})


def test_most_pairs_are_not_compared(spark):
    rng = random.Random(3)
    names = [f"s{i}" for i in range(64)]
    resumes = {i: set(rng.sample(names, rng.randint(20, 50))) for i in range(3000)}
    jobs = {i: set(names) - {names[i]} for i in range(10)}  # every skill is common, every pair shares some
    got = run(spark, jobs, resumes, 5, 8)
    assert {(r.job_id, r.resume_id, r.score, r.label) for r in got} == by_hand(jobs, resumes, 5)
    assert max(r.compared for r in got) < 1000
    rare = {i: {"common", f"t{i % 500}"} for i in range(3000)}
    got = run(spark, {i: {"common", f"t{i}", f"t{i + 1}"} for i in range(20)}, rare, 2, 8)
    assert {(r.job_id, r.resume_id, r.score, r.label) for r in got} == by_hand({i: {"common", f"t{i}", f"t{i + 1}"} for i in range(20)}, rare, 2)


def test_ends_of_odd_rows(spark):
    j = spark.createDataFrame([(1, ["a"]), (1, ["b", None]), (None, ["a"]), (2, None)], "job_id long, skills array<string>")
    r = spark.createDataFrame([(7, ["a"]), (7, ["b", "c"]), (8, None), (None, ["a"]), (9, ["b"])], "resume_id long, skills array<string>")
    assert sorted((x.resume_id, x.score, x.label) for x in covered_ends(j, r, 2).collect()) == [(7, 1.0, 1), (8, 0.0, 0), (9, 0.5, 0), (9, 0.5, 1)]
    assert covered_ends(j.limit(0), r, 2).count() == 0 and covered_ends(j, r.limit(0), 2).count() == 0
