"""Dictionary matching by grams against the column functions and plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions import skills
from textmill.operators import dictionary

WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def by_hand(docs, terms, short):
    out = set()
    for i, text in docs:
        low = (text or "").lower()
        for t in {t for t in terms if t}:
            at = low.find(t)
            while at >= 0:
                before, after = low[at - 1 : at] if at else "", low[at + len(t) : at + len(t) + 1]
                if len(t) > short or ((before in WORD) != (t[0] in WORD) and (after in WORD) != (t[-1] in WORD)):
                    out.add((i, t))
                    break
                at = low.find(t, at + 1)
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    letters = list("abcé .+#x_-")
    docs = [(i, "".join(rng.choice(letters, int(rng.integers(0, 200))))) for i in range(60)]
    terms = ["".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(300)] + [d[1][5 : 5 + int(rng.integers(1, 30))] for d in docs]
    docs += [(100, "C++ and c#, go; GO!"), (101, "google"), (102, None), (103, ""), (None, "go on"), (104, "x" * 100_000 + "needle" + "y" * 10), (1, "machine learning"), (105, "aaaaaaaaaaaaaaaa"), (106, "İstanbul")]
    terms += ["c++", "c#", "go", "needle", "machine learning", "learning", "aaaaaaaa", "aaaaaaaaa", "x" * 50_000 + "needle", "", None, "go", "absent term"]
    return docs, terms


@pytest.mark.parametrize("short", [0, 3])
def test_terms_equal_plain_search(spark, short):
    docs, terms = corpus(short)
    d = spark.createDataFrame(docs, "id long, text string").withColumns({c: F.lit("x") for c in ("copy", "term", "gram", "size")}).repartition(3)
    t = spark.createDataFrame([(x,) for x in terms], "term string").withColumn("text", F.lit("x"))
    got = dictionary.match_terms(d, t, short=short)
    assert {(r.id, r.term) for r in got.collect()} == by_hand(docs, terms, short)
    assert dictionary.match_terms(d.limit(0), t).count() == 0 and dictionary.match_terms(d, t.limit(0)).count() == 0
    plain = d.filter("id >= 100").select("id", skills.match_bounded(F.col("text"), [x for x in terms if x], short).alias("found"))
    lists = dictionary.found_terms(d.filter("id >= 100"), t, short=short)
    assert {r.id: r.found for r in lists.collect()} == {r.id: r.found for r in plain.collect()}


def test_a_large_dictionary(spark):
    """200,000 terms, of which every thousandth stands in a text; none is collected or sent whole."""
    terms = spark.range(200_000).select(F.concat(F.lit("skill "), F.md5(F.col("id").cast("string"))).alias("term"))
    docs = spark.range(200).select("id", F.concat(F.lit("has Skill "), F.md5((F.col("id") * 1000).cast("string")), F.lit(".")).alias("text"))
    assert dictionary.match_terms(docs, terms).count() == 200
