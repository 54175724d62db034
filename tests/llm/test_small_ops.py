"""Operators against brute force on small fixtures, and their defined results for odd rows."""

import collections
import hashlib
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import fingerprints, language, lines, media, mixing, neardup, packing, substrings, tokens
from textmill.llm.arrays import shingle_hashes, text_bytes
from textmill.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names of columns that operators make or use inside.
EXTRA = ["Copy", "rep", "root", "key", "score", "piece", "rank", "label", "spans", "y", "media", "parts", "n", "rate", "__id", "__at", "__cdf", "__n", "__source", "__left", "__lines", "id", "row", "name", "at", "lines", "first", "cdf", "run", "dotted.name"]


def documents(spark, texts, ids=None):
    """A table with extra columns of clashing names."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in EXTRA})


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200)]
    out = [" ".join(rng.choice(words, int(rng.integers(3, 120)))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies, exact copies, shared passages
        base = out[i].split()
        base[len(base) // 2] = "changed"
        out.append(" ".join(base))
        out.append(out[i])
    passage = " ".join(rng.choice(words, 100))
    out += [f"{words[i]} {passage} {words[-i]}" for i in range(6)]
    return [*out, "", None, "   ", "one", "ONE", "é ü ß 日本", "x" * 3000, "ab " * 900]


def bag(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- near duplicates ----------------------------------------------------------------------------------------------


def shingles(text):
    w = bag(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(sets, percent=85):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_against_all_pairs(spark):
    texts = corpus()
    got = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    want = groups(sets)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in range(len(texts)))


def altered(rng, base, most):
    words = list(base)
    for k in rng.choice(len(base), int(rng.integers(0, most)), replace=False):
        words[k] = f"x{rng.integers(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize(("small", "block"), [(16, 1500), (2, 20), (1000, 20)])
def test_near_duplicates_links_across_groups_of_a_bucket(spark, monkeypatch, small, block):
    rng = np.random.default_rng(3)
    texts = [altered(rng, [f"w{i}" for i in range(150)], 4) for _ in range(90)]
    monkeypatch.setattr(neardup, "SMALL_GROUP", small)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(90)] == groups([shingles(t) for t in texts])


def test_rarest_shingles_of_like_sets_meet():
    rng = np.random.default_rng(4)
    seen = rng.integers(0, 50, 1 << neardup.SLOT_BITS)
    for percent in (80, 85, 100):
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = (neardup.prefix(s, seen, percent) for s in (a, b))
                assert len(np.intersect1d(x, y)) and len(x) == len(a) - -(-percent * len(a) // 100) + 1


def test_near_duplicates_in_a_bucket_of_twenty_thousand(spark):
    """A passage makes up two thirds of each text: buckets hold nearly all of them, but hardly any are alike enough."""
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda k: F.concat(F.lit("u"), F.floor(F.col("id") / 2), F.lit("v"), k)), " "), F.when(F.col("id") % 2 == 1, F.lit(" end")).otherwise(F.lit(""))).alias("text"))
    got = neardup.near_duplicates(docs.repartition(8))
    wrong = got.filter(F.col("component_id") != F.floor(F.col("doc_id") / 2) * 2).count()
    assert wrong == 0


def test_near_duplicates_odd_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "z", None], [5, 5, None, 7])
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()) == [(5, 5), (5, 5), (7, 7)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "None"] and kept.columns == docs.columns
    twice = documents(spark, ["a b c d e f", "g h i j k l m", "g h i j k l m", "g h i j k l m"], [5, 5, 9, 5])
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(twice).collect()) == [(5, "a b c d e f"), (5, "g h i j k l m")]


def test_near_duplicates_of_many_equal_rows(spark, monkeypatch):
    """Rows alike in id and text are compared once: comparisons grow with distinct texts."""
    base = [f"w{i}" for i in range(150)]
    near, other = " ".join(base), " ".join([*base[:148], "x", "y"])
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(near).alias("text"))
    docs = rows.union(rows.select(F.lit(2).cast("long"), F.lit(other))).union(documents(spark, ["alone in the world with words"], [3]).select("doc_id", "text"))
    compared, real = [], neardup._confirmed

    def counted(pairs, texts, percent):
        a, b = (texts.select(F.col("rep").alias(c)) for c in "ab")
        compared.append(pairs.join(a, "a").join(b, "b").count())
        return real(pairs, texts, percent)

    monkeypatch.setattr(neardup, "_confirmed", counted)
    got = neardup.near_duplicates(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5000), (2, 1, 5000), (3, 3, 1)]
    assert sum(compared) < 5


def test_near_duplicates_of_very_long_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(10**5, size=250_000)]
    texts = [" ".join(words), " ".join(words[:-300]), " ".join(words[: len(words) // 2]), "same " * 300_000]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i][0] for i in range(4)] == [0, 0, 2, 3] and got[3][1] == 1 and len(texts[0]) > 10**6


def test_super_minhash():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(base[:300]), np.unique(base[100:])
    s = neardup.super_minhash([a, b, np.zeros(0, np.uint64), a[:3]], 256)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1
    assert (s[2] == np.iinfo(np.int64).max).all() and len(np.unique(neardup.super_minhash([a[:1]], 64)[0] >> 32)) == 64


def test_words_are_those_of_the_pattern():
    texts = ["a\tb\x0bC d\x1ce", "x", "", "É é\n"]
    sets = shingle_hashes(*text_bytes(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert shingle_hashes(*text_bytes(pa.array(["A b C"])))[0] == shingle_hashes(*text_bytes(pa.array(["a  B\nc"])))[0]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (5, 5), (None, 4), (20, 1)], "a long, b long")
    assert {r.node: r.root for r in connected(links).collect()} == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, 10: 7}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected(chain).collect()} == {0}
    assert connected(links.limit(0)).count() == 0


# -- repeated strings ---------------------------------------------------------------------------------------------


def without_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def passage_words(texts, size):
    bags = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    homes = collections.defaultdict(set)
    for i, w in enumerate(bags):
        for k in range(len(w) - size + 1):
            homes[tuple(w[k : k + size])].add(i)
    out = []
    for w in bags:
        inside = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if len(homes[tuple(w[k : k + size])]) > 1:
                inside[k : k + size] = True
        out.append(int(inside.sum()))
    return out


@pytest.mark.parametrize(("length", "words"), [(400, 51), (120, 20), (7, 3)])
def test_repeats_against_all_windows(spark, length, words):
    texts = corpus()
    texts += ["tick tock " * 70, "tick tock " * 70 + "end", "lone " * 200]  # periods, within one text and across
    rows = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, texts), length, words).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in map(rows.get, range(len(texts)))] == without_repeats(texts, length)
    assert [rows[i].n_passage_words for i in range(len(texts))] == passage_words(texts, words)


def test_repeats_by_rounds_of_buckets(spark):
    """Every live bucket of a round holds strings alike in what its runs share; identifiers follow from the round before."""
    units = substrings.bytes_units(120)
    texts = [t or "" for t in corpus()]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, copy long, text string")
    rounds = []
    substrings.repeated_spans(docs, units, rounds).collect()
    assert len(rounds) == 1 + len(units.widths()) and units.widths()[-1] == 1
    assert all(hi - lo < w for w, live in zip(units.widths(), rounds[1:], strict=True) for *_, lo, hi in live)
    for live in rounds:
        members = collections.Counter(k for k, *_ in live)
        assert min(members.values()) > 1  # a run alone in its bucket is done
        assert not {k for k, _, is_open, *_ in live if is_open} - {k for k, whole, *_ in live if not whole}
    assert len(rounds[0]) > 100 and all(whole and not is_open for _, whole, is_open, *_ in rounds[-1])

    raw = np.frombuffer((texts[0] + texts[0][:300]).encode(), np.uint8)  # the same strings at two places
    spans = substrings.Spans(substrings.BYTE_CODES[raw])
    got = substrings.anchors(substrings.BYTE_CODES[raw], np.array([0, len(raw)]), units)
    k, a, lo, hi, before = got["k"], got["a"], got["lo"], got["hi"], None
    for width in units.widths():
        cut = substrings.narrower(spans, a, lo, hi, k, units, width, before)
        a = a[cut["row"]]
        shared = collections.defaultdict(set)
        for number, anchor, x in zip(cut["k"], a, (a - cut["hi"]) // width, strict=True):
            begin, end = anchor - x * width, anchor - min((x + 1) * width - 1, units.length - units.gram) + units.length
            shared[number].add((raw[begin:end].tobytes(), int(x)))
        assert all(len(v) == 1 for v in shared.values()) and len({next(iter(v)) for v in shared.values()}) == len(shared)
        other = substrings.narrower(spans, a[:1], cut["lo"][:1], cut["hi"][:1], cut["k"][:1] + 1, units, 1, width)
        same = substrings.narrower(spans, a[:1], cut["lo"][:1], cut["hi"][:1], cut["k"][:1], units, 1, width)
        assert not set(other["k"]) & set(same["k"])  # an identifier depends on the one before
        k, lo, hi, before = cut["k"], cut["lo"], cut["hi"], width


def test_repeats_odd_rows(spark):
    docs = documents(spark, ["q" * 399, "r" * 100 + "s" * 400, "r" * 100 + "s" * 400, None], [1, 3, 3, None])
    got = sorted(((r.doc_id or 0), r.n_removed, len(r.kept), len(r.removed), r.n_passage_words) for r in substrings.remove_repeats(docs).collect())
    assert got == [(0, 0, 0, 0, 0), (1, 0, 399, 0, 0), (3, 500, 0, 1, 0), (3, 500, 0, 1, 0)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    words = " ".join(f"w{i}" for i in range(60))
    got = {r.text_id: r for r in substrings.remove_repeats(documents(spark, [words, "x " + words, words], [4, 4, 4])).withColumnRenamed("doc_id", "text_id").select("text_id", "n_passage_words").distinct().collect()}
    assert got[4].n_passage_words == 60  # texts of one id are documents of their own


def test_repeats_in_many_equal_rows(spark):
    """Equal rows have the same runs: after the first round these are as many as in one row."""
    words = " ".join(f"w{i}" for i in range(60))
    shared = "one two three four five"

    def live(n):
        rows = spark.range(n).select(F.lit(4).cast("long").alias("id"), F.lit(11).cast("long").alias("copy"), F.lit(f"{words} {shared} {words[::-1]}").alias("text"))
        other = " ".join(f"v{i}" for i in range(60))
        rows = rows.union(spark.createDataFrame([(5, 12, f"{other} {shared} {words} {other[::-1]}")], rows.schema))
        rounds = []
        spans = {(r.id, r.copy): sorted((x.lo, x.hi) for x in r.spans) for r in substrings.repeated_spans(rows, substrings.word_units(51), rounds).collect()}
        return spans, [len(r) for r in rounds]

    once, sizes = live(1)
    many, grown = live(5000)
    assert many == once and grown[1:] == sizes[1:] and set(once) == {(4, 11), (5, 12)}


def test_repeats_in_very_long_texts(spark):
    rng = np.random.default_rng(2)
    body = "".join(rng.choice(list("abcdefgh "), 1_500_000))
    texts = [body, body[:1000] + "#" + body[700_000:], "same " * 100_000]
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(3)] == [801_000, 801_000, 500_000] and [got[i].n_spans for i in range(3)] == [2, 2, 1]


# -- line windows -------------------------------------------------------------------------------------------------


def test_line_windows(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "b\nc\nd", "q\nq\nq\nq\nq", "\n\n\n\n", "a\nb", None, ""]
    rows = {r.doc_id: r for r in lines.drop_repeated_windows(documents(spark, texts)).collect()}
    assert [rows[i].text for i in range(8)] == ["a\nb\nc\nd", "x\ny", "", "q", "\n\n\n\n", "a\nb", None, ""]
    assert [rows[i].n_removed for i in range(8)] == [0, 3, 3, 4, 0, 0, 0, 0]
    assert [rows[i].n_lines for i in range(8)] == [4, 5, 3, 5, 5, 2, 0, 1]


def test_line_windows_odd_rows_and_plan(spark):
    docs = documents(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc"], [2, 2, None]).withColumn("n_lines", F.lit("old"))
    out = lines.drop_repeated_windows(docs)
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("2", ""), ("2", ""), ("None", "a\nb\nc")]
    assert set(docs.columns) <= set(out.columns)
    assert lines.drop_repeated_windows(docs.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- mixing -------------------------------------------------------------------------------------------------------


def test_poisson_counts(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 15000, "a").when(F.col("id") < 19998, "b").alias("source"))
    table = mixing.rates(docs, exponent=0.5)
    want = {r.source: r.rate * r.n for r in table.collect()}
    out = mixing.replicate(docs, table, seed=1)
    got = {r.source or "": r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(got[s] - w) < 6 * w**0.5 for s, w in want.items()) and abs(sum(want.values()) - 20000) < 1e-6
    per = out.filter("source = 'b'").groupBy("doc_id").count().groupBy("count").count().collect()
    rate = next(r.rate for r in table.collect() if r.source == "b")
    ones = next(r[1] for r in per if r[0] == 1)
    assert abs(ones / 4998 - rate * np.exp(-rate)) < 0.03
    keys = [r.shuffle_key for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert out.exceptAll(mixing.replicate(docs.repartition(7), table, seed=1)).isEmpty()
    assert max(r.copy for r in out.select("copy").collect()) > 64  # the rare null source, drawn in pieces


def test_mixing_weights_and_odd_rows(spark):
    docs = documents(spark, ["a", None, ""], [1, None, 1])
    assert mixing.replicate(docs, mixing.rates(docs, weights={})).count() == 0
    assert mixing.replicate(docs.limit(0), mixing.rates(docs.limit(0))).count() == 0
    many = mixing.replicate(docs, mixing.rates(docs, weights={"s": 1.0}, total=300))
    n = {r.text: r["count"] for r in many.groupBy("text").count().collect()}
    assert n["a"] == n[""] and set(n) == {"a", "", None} and many.columns == [*[c for c in docs.columns if c != "Copy"], "copy", "shuffle_key"]
    assert {x for r in many.drop("copy", "shuffle_key").collect() for c, x in r.asDict().items() if c in EXTRA} == {"x"}


# -- packing ------------------------------------------------------------------------------------------------------


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


ODD = ["a  b\n\n c'd 's don't  ", "", "   ", "\n", " \nfoo", "foo \n bar\t\tbaz  12a,,,b' s", "héllo wörld ×÷ a", "日本語 text", "a\x1cb", "!!  !! 'x", "\r\n\r\nx  ", "<|endoftext|> x", "ÿ z", "é"]


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "SLOT_BITS", 6)  # a small table of known words, so that slots clash
    encoder = tokens.WordEncoder(*vocabulary())
    texts = ODD + [t or "" for t in corpus()]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(*text_bytes(pa.array(texts)))] == reference_ids(texts)


def test_packing_is_gapless_and_whole(spark):
    texts = corpus(20) + ODD + ["word " * 5000, "y" * 9000]
    rows = packing.pack(documents(spark, texts), *vocabulary(), capacity=256).collect()
    ids = [[*x, 0] for x in reference_ids(texts)]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, want in enumerate(ids):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(want)
        assert all(p.length == 256 for p in pieces[1:]) and len(pieces) == -(-len(want) // 256)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *want[at : at + p.length]))
            at += p.length
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= 1.1 * sum(map(len, ids)) / 256 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    sizes = [np.clip(rng.lognormal(6, 1, 3000).astype(int), 1, 2048), rng.integers(700, 1100, 900), np.full(7, 2048), rng.integers(1, 9, 50)][seed]
    lengths, counts = np.unique(sizes, return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    runs = packing.plan(histogram, 2048)
    ranks, used = collections.defaultdict(list), collections.defaultdict(int)
    for n, rank, many, first, offset in sorted(runs, key=lambda r: r[4]):
        ranks[n] += range(rank, rank + many)
        for s in range(first, first + many):
            assert used[s] == offset
            used[s] += n
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items()) and max(used.values()) <= 2048
    greedy = packing._Bins(2048)
    for n in sorted(histogram, reverse=True):
        greedy.best_fit(n, 0, histogram[n])
    assert len(used) <= greedy.next * 1.02 + 1


def test_packing_odd_rows(spark):
    docs = documents(spark, [None, "a", "a"], [None, 1, 1])
    rows = packing.pack(docs, *vocabulary()).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 2), ("None", 1)] and {r.sequence_id for r in rows} == {0}
    assert packing.pack(docs.limit(0), *vocabulary()).count() == 0


# -- fingerprints -------------------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = collections.Counter(bag(a)), collections.Counter(bag(b))
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def test_fingerprints(spark):
    texts = corpus()
    ids = [3 * i - 50 for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents(spark, texts, ids).orderBy(F.rand(1))).collect()}
    off = []
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[ids[i]]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, following)]
        if t == edited:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.09
    same = [got[ids[i]].fingerprint for i, t in enumerate(texts) if t == texts[0]]
    assert len(same) > 1 and len(set(same)) == 1


def test_fingerprints_estimate_is_unbiased(monkeypatch):
    monkeypatch.setattr(fingerprints, "SAMPLES", 2000)
    monkeypatch.setattr(fingerprints, "CACHE_BITS", 8)
    pairs = [("a a a b c", "a b b d"), ("a b", "a b"), ("x", "y"), ("k " * 9 + "l", "k " * 3 + "l l")]
    s = fingerprints.Sampler().signatures([t for p in pairs for t in p])
    for i, (a, b) in enumerate(pairs):
        assert abs((s[2 * i] == s[2 * i + 1]).mean() - jaccard(a, b)) < 0.05


def test_fingerprints_odd_rows(spark):
    docs = documents(spark, ["b b", "a a", None, "c"], [4, 4, None, None])
    rows = fingerprints.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == [("4", 3), ("4", 3), ("None", 0), ("None", 1)]
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprints(documents(spark, ["ab cd"], [9])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


# -- media --------------------------------------------------------------------------------------------------------


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
BMP = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


def gz():
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    return c.compress(b"hello" * 99) + c.flush()


JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0?\0" + b"\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"


def zipped():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


PDF_AGAIN = PDF + b"\n2 0 obj\nxref\ntrailer\nstartxref\n20\n%%EOF"
JPEG_FILLED = JPEG.replace(b"\xff\xda", b"\xff\xff\xff\xda")
FLAC = b"fLaC\x80\0\0\x22" + b"\1" * 34 + b"\xff\xf8" + b"\2" * 20
OGG = b"".join(struct.pack("<4sBBqIIIB", b"OggS", 0, flags, 0, 7, seq, 0, 2) + b"\x03\x02" + b"abcde" for seq, flags in enumerate((2, 0, 4)))
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"moov") + b"abcd" + struct.pack(">IQ", 1, 0)[:4] + b"mdat" + struct.pack(">Q", 20) + b"wxyz"
TIFF = b"II*\0" + struct.pack("<I", 12) + b"data" + struct.pack("<HHHIIHHIII", 2, 273, 4, 1, 8, 279, 4, 1, 4, 0)
FILES = {"audio/flac": FLAC, "audio/ogg": OGG, "video/mp4": MP4, "image/tiff": TIFF, "image/png": png(), "image/gif": GIF, "image/bmp": BMP, "application/gzip": gz(), "image/jpeg": JPEG, "application/pdf": PDF, "application/zip": zipped(), "audio/wav": media.wav(b"\x80" * 7)}


@pytest.mark.parametrize("kind", FILES)
def test_whole_and_carved_files(kind):
    data = FILES[kind]
    assert media.sniff(data)[0] == kind
    tail = b" tail BM GIF89a RIFF \xff\xd8\xff"
    whole, parts = media.sniff(b"noise " + data + tail)
    assert whole is None and parts == [(kind, 6, 6 + len(data) + (len(tail) if kind == "audio/flac" else 0))]
    if kind != "audio/flac":
        assert media.sniff(data[: len(data) * 2 // 3])[0] is None  # magic alone is no proof


def test_files_in_files():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:  # stored, not packed
        z.writestr("inner.zip", zipped())
        z.writestr("x.png", png())
    assert media.sniff(out.getvalue()) == ("application/zip", [])
    assert media.sniff(b"-" + out.getvalue() + zipped())[1] == [("application/zip", 1, 1 + len(out.getvalue())), ("application/zip", 1 + len(out.getvalue()), 1 + len(out.getvalue()) + len(zipped()))]
    assert media.sniff(b"-" + PDF_AGAIN + b"--" + PDF)[1] == [("application/pdf", 1, 1 + len(PDF_AGAIN)), ("application/pdf", 3 + len(PDF_AGAIN), 3 + len(PDF_AGAIN) + len(PDF))]
    enclosing = PDF[:20] + PDF + PDF[20:]
    assert media.sniff(enclosing) == ("application/pdf", [])
    assert media.sniff(b"-" + JPEG_FILLED)[1] == [("image/jpeg", 1, 1 + len(JPEG_FILLED))]
    assert media.sniff(PDF + b"--" + GIF) == ("application/pdf", [("image/gif", len(PDF) + 2, len(PDF) + 2 + len(GIF))])


@pytest.mark.parametrize("magic", [*dict.fromkeys(m for m, *_ in media.FORMATS), b"%PDF-1", b"PK\x05\x06", b"\x1f\x8b\x08\x08", b"startxref 1 "])
def test_a_megabyte_of_magic_bytes_takes_no_time(magic):
    import time

    data = magic * (1_000_000 // len(magic))
    began = time.process_time()
    assert media.sniff(data) == (None, [])
    assert time.process_time() - began < 6  # about a second alone; the machine may be busy


def test_media_columns(spark):
    rows = [("image/png", png()), ("image/png", GIF), ("text/plain", b"plain"), ("x/y", b"\0" + png() + GIF), (None, None), ("a/b", b"")]
    got = media.sniff_media(spark.createDataFrame([(t, bytearray(b) if b is not None else None) for t, b in rows], "declared_type string, media binary"))
    out = got.collect()
    assert [(r.media_type, r.corrected) for r in out] == [("image/png", False), ("image/gif", True), ("text/plain", False), ("x/y", False), (None, False), ("a/b", False)]
    assert [(r.part_type, bytes(r.part)) for r in media.carve(got).collect()] == [("image/png", png()), ("image/gif", GIF)]
    clashing = media.carve(media.sniff_media(got.withColumns({"Part": F.lit("x"), "row": F.lit("y"), "a.b": F.lit("z")})))
    assert [(r.part_type, r.row, r["a.b"]) for r in clashing.collect()] == [("image/png", "y", "z"), ("image/gif", "y", "z")]


def test_text_round_trip(spark):
    texts = [t or "" for t in corpus()] + ["z" * 64, "é" * 32]
    docs = documents(spark, texts)
    stored = {r.doc_id: bytes(r.media) for r in media.store_texts(docs).collect()}
    for r in media.sound_digests(media.sniff_media(media.store_texts(docs))).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.media_type) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest(), "audio/wav")
    kinds = {r.declared_type: r.corrected for r in media.sniff_media(media.store_texts(docs)).select("declared_type", "corrected").distinct().collect()}
    assert kinds == {k: k != "audio/wav" for k in media.DECLARED}
    long = "payload " * 200_000
    [got] = media.sound_digests(media.sniff_media(media.store_texts(documents(spark, [long])))).collect()
    assert got.n_bytes == got.payload_bytes == len(long) and got.payload_sha256 == hashlib.sha256(long.encode()).hexdigest()
    odd = documents(spark, [None, "a"], [None, None])
    assert sorted(r.n_bytes for r in media.sound_digests(media.sniff_media(media.store_texts(odd))).collect()) == [0, 1]
    assert media.sound_digests(media.sniff_media(media.store_texts(docs.limit(0)))).count() == 0


# -- language -----------------------------------------------------------------------------------------------------


def gram_sets(texts):
    folded = ["".join(c if c.islower() and c.isascii() or ord(c) > 127 else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), t)).encode() for t in texts]
    return [{w[i : i + n] for n in language.SPECTRUM for i in range(len(w) - n + 1)} for w in folded]


def test_kernel_weights_equal_the_kernel():
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "the end", "und das ende"] * 3
    found = language.presence(*text_bytes(pa.array(texts)))
    marks = language.Landmarks(found)
    direct = np.array([marks.kernel(f) for f in found])
    grams = gram_sets(texts)
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in grams] for a in grams]
    assert np.abs(direct - np.array(want)).max() < 0.002  # up to clashes of hashes
    names, coefficients = language.fit(direct, direct, ["en", "de", "fr", "en", "de"] * 3)
    margin = language.margins(found, marks.row, marks.folded(coefficients))
    assert np.allclose(margin, direct @ coefficients, atol=1e-4)
    assert [names[i] for i in margin.argmax(axis=1)] == ["en", "de", "fr", "en", "de"] * 3


def test_predictions_against_a_direct_solve(spark):
    """Kernel ridge regression with all training texts as landmarks, solved in the dual."""
    rng = np.random.default_rng(7)
    parts = {"en": ["the", "and", "ing", "tion", "es"], "de": ["sch", "und", "ung", "ß", "es"], "fr": ["eau", "é", "que", "ç", "es"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(int(rng.integers(1, 12)))), k) for i, k in enumerate(rng.choice(list(parts), 240, p=[0.6, 0.3, 0.1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.languages(docs).collect()}
    grams = gram_sets([r[1] for r in rows])
    learn = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2]
    k = np.array([[len(grams[i] & grams[j]) / (len(grams[i]) * len(grams[j])) ** 0.5 for j in learn] for i in range(240)])
    names = sorted(parts)
    y = np.array([[1.0 if rows[i][2] == n else -1.0 for n in names] for i in learn])
    many = collections.Counter(rows[i][2] for i in learn)
    weight = np.array([len(learn) / 3 / many[rows[i][2]] for i in learn])
    alpha = np.linalg.solve(k[learn] + language.RIDGE * len(learn) * np.diag(1 / weight), y)
    margin = k @ alpha
    sure = np.sort(margin, axis=1)[:, -1] - np.sort(margin, axis=1)[:, -2] > 0.01
    assert sure.mean() > 0.95 and all(got[i] == names[margin[i].argmax()] for i in np.flatnonzero(sure))


def test_many_languages_of_some_rows_are_all_learned(spark):
    usable = spark.range(18_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 1500) AS lang")
    drawn = language._sampled(usable, 4000)
    assert drawn.select("lang").distinct().count() == 1500 and 3600 < drawn.count() < 4400
    over = language._sampled(usable, 1000)  # more languages than rows: drawn by share
    assert 800 < over.count() < 1200


def test_languages_at_one_margin(spark):
    rows = [(i, "same words for all", lang) for i, lang in enumerate(["b", "a", "c"] * 20)]
    docs = spark.createDataFrame([(3 * k + j, t, lang) for k in range(20) for j, (_, t, lang) in enumerate(rows[:3])], "doc_id long, text string, lang string")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    learned = collections.Counter(rows[i][2] for i in range(60) if i not in held)
    got = {r.doc_id: r.lang_pred for r in language.languages(docs).collect()}
    assert len(set(got.values())) == 1 and set(got.values()) <= set(learned)
    assert got == {r.doc_id: r.lang_pred for r in language.languages(docs.repartition(7)).collect()}


def test_more_languages_than_a_thousand(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 5, f"l{i:04d}") for i in range(1600)]
    usable = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language._sampled(usable, 4000).select("lang").distinct().count() == 1600


def test_languages_of_very_long_texts(spark):
    rng = np.random.default_rng(8)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["sch", "und", "ung", "ß"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(40)), k) for i, k in enumerate(["en", "de"] * 60)]
    rows += [(1000 + i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(200_000)), None) for i, k in enumerate(["en", "de"])]
    got = {r.doc_id: r.lang_pred for r in language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000] == "en" and got[1001] == "de" and len(rows[-1][1]) > 10**6


def test_languages(spark):
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["sch", "und", "ung", "ß"], "fr": ["eau", "é", "que", "ç"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(30)), k) for i, k in enumerate(rng.choice(list(parts), 200))]
    rows += [(1000, None, "en"), (1001, " 12 !", None), (1002, "", "de"), (None, "schund ungß", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in EXTRA if c != "score"})
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[None].lang_pred == "de" and got[None].held_out
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(200) if got[i].held_out] == held and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(docs.limit(0)).count() == 0
    assert unicodedata.category("ß")[0] == "L"
