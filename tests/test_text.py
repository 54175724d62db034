import pytest
from pyspark.sql import functions as F

from textmill.config import KEYWORD_STOP_WORDS, SECTION_WEIGHTS, SKILL_VOCABULARY
from textmill.functions import sections, skills, text, vectors


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "gone"),
    [("Contact me at john@example.com for details", "john@example.com"), ("Call +1-555-123-4567 today", "555-123-4567"), ("Visit https://www.example.com for more", "https://www.example.com")],
)
def test_personal_data_goes(spark, raw, gone):
    assert gone not in one(spark, raw, text.normalize_text)


def test_bullets_first_and_literal(spark):
    raw = "• Item one\n► Item two\n★ Item three"
    assert one(spark, raw, text.normalize_text) == "- Item one\n- Item two\n- Item three"
    assert "- Item" not in one(spark, raw, lambda c: text.normalize_text(c, bullets_first=False))


def test_empty_null_and_case(spark):
    assert one(spark, "", text.normalize_text) == one(spark, None, text.normalize_text) == ""
    assert one(spark, "Senior Developer", lambda c: text.normalize_text(c, lowercase=True)) == "senior developer"
    assert one(spark, "café résumé naïve", text.fold_ascii) == "cafe resume naive"
    assert one(spark, "Senior Python Developer", lambda c: text.normalize_text(c, remove_personal_info=False)) == "Senior Python Developer"
    assert one(spark, "work 2016–2020 on", text.normalize_text) == "work 2016-2020 on"


def test_ingest_and_upload(spark):
    raw = "a@b.c x\n\n\n\ny +12 345 678 901 "
    assert one(spark, raw, text.clean_text) == "x\ny"
    assert one(spark, raw, text.mask_personal) == "[email] x\n\ny [phone] "


def test_words_and_keywords(spark):
    assert one(spark, "  a  b\tc ", text.word_count) == 3
    assert one(spark, None, text.word_count) == 0
    assert sorted(one(spark, "The cat, éabc and the CAT of ab", lambda c: text.keywords(c, KEYWORD_STOP_WORDS))) == ["cat", "éabc"]
    assert len(set(SKILL_VOCABULARY)) == 138


def test_skills(spark):
    assert one(spark, "JavaScript and Go; regression.", lambda c: skills.match_bounded(c, ["java", "go", "c++", "r", "regression"])) == ["go", "java", "regression"]
    assert one(spark, "JavaScript", lambda c: skills.match_substring(c, ["java", "script", "go"])) == ["java", "script"]
    many = [f"w{i:04d}" for i in range(300)]
    assert one(spark, "xw0007 w0299", lambda c: skills.match_substring(c, many)) == ["w0007", "w0299"]


def test_coverage_and_sets(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), ([], ["a"]), (["a"], []), (None, None)], "h array<string>, r array<string>")
    assert [round(r[0], 3) for r in rows.select(skills.coverage(F.col("h"), F.col("r"))).collect()] == [0.333, 0.0, 0.0, 0.0]
    bridge = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "x")], "job_id long, skill_abr string")
    names = spark.createDataFrame([("x", "Sql"), ("x", "Sql"), ("y", "Java")], "skill_abr string, skill_name string")
    assert {r.job_id: r.skills for r in skills.skill_sets(bridge, names, "job_id").collect()} == {1: ["java", "sql"], 2: ["sql"]}


RESUME = "John Doe\n\nEXPERIENCE\nDeveloper\n\nEDUCATION\nMS\n\n* Skills:\nPython Java Go Rust C++\n\nWork history\nmore\n"


def test_sections(spark):
    docs = spark.createDataFrame([("a", RESUME), ("b", "plain text"), ("c", ""), ("d", None), ("e", "\n\nSKILLS\nx")], "id string, text string")
    got = {(r.id, r.section): r for r in sections.sections(docs, "id", "text").collect()}
    assert {s for i, s in got if i == "a"} == {"header", "experience", "education", "skills"}
    assert got["a", "experience"].content == "Developer\n\n\nmore" or got["a", "experience"].content == "Developer\nmore"
    assert (got["a", "experience"].start_line, got["a", "experience"].end_line) == (2, 13)
    assert got["a", "skills"].word_count == 5 and got["b", "other"].content == "plain text"
    assert {s for i, s in got if i in "cd"} == set() and {s for i, s in got if i == "e"} == {"skills"}
    weighted = {r.id: r.weighted for r in sections.weighted_text(docs, "id", "text").collect()}
    assert weighted["a"].count("Python") == int(SECTION_WEIGHTS["skills"]) and weighted["d"] == "" and weighted["b"] == "plain text"


def test_header_lines(spark):
    cases = {"== SKILLS ==": "skills", "MS, Stanford University": "education", "x" * 61 + "skills": None, "": None, "Academic Projects": "education", "plain": None, "1. Awards": "achievements"}
    for line, want in cases.items():
        assert one(spark, line, sections.header_of) == want
    assert one(spark, "MS, Stanford University", lambda c: sections.header_of(c, strict=True)) is None


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    encoder = vectors.HashingEncoder(16)
    docs = spark.createDataFrame([("same words here",), ("same words here",), (None,)], "t string")
    got = [r[0] for r in docs.select(vectors.encode(encoder, 2)("t")).collect()]
    assert got[0] == got[1] == encoder.encode(["same words here"])[0] and not any(got[2])


def test_fold_equals_the_exact_fold_on_all_code_points(spark):
    import unicodedata

    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    rows = ["a" + "b".join(points[i : i + 4096]) for i in range(0, len(points), 4096)]
    got = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", text.fold_ascii(F.col("t")).alias("f")).collect()
    want = [unicodedata.normalize("NFKD", r).encode("ascii", "ignore").decode() for r in rows]
    assert [r.f for r in sorted(got, key=lambda r: r.id)] == want


def test_terms_by_automaton_equal_terms_one_by_one(spark, monkeypatch):
    terms = ["go", "c++", "r", "java", "script", ".net", "a b", "_x", "naïve"]
    values = ["Go c++ R java", "cargo c++x r2 javascript", "c++", "ngo .net a.net a b", "_x y_x naïve r", "", None, "r_ r-"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")
    each = {r.id: r.m for r in frame.select("id", skills.match_bounded(F.col("t"), terms).alias("m")).collect()}
    monkeypatch.setattr(skills, "LITERALS", 0)
    assert each == {r.id: r.m for r in frame.select("id", skills.match_bounded(F.col("t"), terms).alias("m")).collect()}
    import re

    def stands(t, v):
        return v in t if len(v) > 3 else re.search(rf"\b{re.escape(v)}\b", t, re.A) is not None

    assert each == {i: sorted(v for v in terms if stands((t or "").lower(), v)) for i, t in enumerate(values)}


def test_sections_stay_in_the_row(spark):
    docs = spark.createDataFrame([(1, "Skills\npython\n\nEducation\nMS\nSkills:\nsql"), (2, "\n \nno header"), (3, ""), (4, None), (5, "Skills"), (6, "\n\nskills\n")], "id long, t string")
    got = sections.sections(docs, "id", "t")
    assert {(r.id, r.section): tuple(r[2:]) for r in got.collect()} == {(1, "skills"): ("python\nsql", 0, 6, 2, 1), (1, "education"): ("MS", 3, 4, 1, 2), (2, "other"): ("no header", 0, 2, 2, 0), (5, "skills"): ("", 0, 0, 0, 1), (6, "skills"): ("", 2, 3, 0, 1)}
    assert [tuple(r) for r in sections.section_lines(docs.filter("id = 6"), "id", "t").collect()] == [(6, 0, "", None, 0), (6, 1, "", None, 0), (6, 2, "skills", "skills", 1), (6, 3, "", None, 1)]
    assert {r.id: r.weighted for r in sections.weighted_text(docs, "id", "t").collect()}[5] == "Skills"
    for frame in (got, sections.section_lines(docs, "id", "t"), sections.weighted_text(docs, "id", "t"), sections.parsed(docs, "id", "t")):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
