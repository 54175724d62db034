"""Classifiers on held-out rows, index against brute force, and the pipeline against a brute-force version."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import labelled, mixing, packing, quality, toxicity
from textmill.llm.arrays import text_bytes
from textmill.llm.queries import _vocabulary

from .test_small_ops import EXTRA, bag, groups, reference_ids, shingles


def labelled_corpus(n=600, seed=5):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(30, 80))))
        junk, toxic = rng.random() < 0.3, rng.random() < 0.3
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " you vile" + str(rng.choice(["toad", "worm", "slug"])) + " wretch"
        rows.append((i, text, f"s{i % 3}", int(not junk), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, q, x in rows if i is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(got, rows, column):
    return np.mean([got[r[0]].predicted == r[column] for r in rows if held(r[0])])


def test_quality_on_held_out_rows(spark):
    rows = labelled_corpus()
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in quality.quality_scores(docs.withColumns({c: F.lit("x") for c in EXTRA}), labels).collect()}
    assert accuracy(got, rows, 3) > 0.95 and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())


def test_toxicity_on_held_out_rows(spark):
    rows = labelled_corpus()
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs.withColumns({c: F.lit("x") for c in EXTRA}), labels).collect()}
    assert accuracy(got, rows, 4) > 0.95 and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert not any(e.doc_id == i or held(e.doc_id) for i, r in got.items() for e in r.evidence)


def test_held_out_labels_change_nothing(spark):
    rows = labelled_corpus(200)
    docs, labels = tables(spark, rows)
    flipped = labels.withColumns({c: F.when(labelled.held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, flipped))
        assert a == b


def test_classifiers_odd_rows(spark):
    rows = [*labelled_corpus(60), (None, "abc def", "s", 1, 0), (901, None, "s", 1, 1), (902, "", "s", 0, 0), (902, "?!", "s", 0, 0)]
    docs, labels = tables(spark, rows)
    bare = labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    for run, name in ((quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")):
        got = run(docs, labels).collect()
        assert len(got) == len(rows) and all(0 < r.score < 1 for r in got) and next(r for r in got if r.doc_id is None).held_out
        assert {round(r.score, 6) for r in run(docs, bare).collect()} == {0.5}
        assert run(docs.limit(0), labels).count() == 0
        one = labels.withColumn(name, F.lit(1))
        assert len({round(r.score, 6) for r in run(docs, one).collect()}) >= 1


def test_training_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    usable = [i for i in range(5000) if not held(i)]
    n = labelled.training_sample(labels, "toxic", 500)[0].count()
    assert 400 < n < 600 and labelled.training_sample(labels, "toxic", 10**6)[0].count() == len(usable)
    rows, share = labelled.training_sample(labels, "toxic", 500, by_label=True)
    by = collections.Counter(r.y for r in rows.collect())
    assert 180 < by[0] < 320 and 180 < by[1] < 320 and abs(share - sum(i % 10 == 0 for i in usable) / len(usable)) < 0.001
    few = labelled.training_sample(labels, "toxic", 2000, by_label=True)[0]
    by = collections.Counter(r.y for r in few.collect())
    assert by[1] == sum(i % 10 == 0 for i in usable) and 1800 < sum(by.values()) < 2200
    texts = spark.createDataFrame([(1, "b", 0), (1, "a", 0), (2, "c", 1)], "doc_id long, text string, y int")
    assert sorted(tuple(r) for r in labelled.one_text_each(texts).collect()) == [(1, "a", 0), (2, "c", 1)]


def toxicity_by_hand(docs, labels):
    """Scores of (id, text) rows by dense vectors, with labels by id."""
    bags = [collections.Counter(re.findall("[a-z\x80-\uffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in docs]
    df = collections.Counter(w for b in bags for w in b)
    known = [i for i, (d, _) in enumerate(docs) if d in labels and not held(d)]
    y = np.array([labels[docs[i][0]] for i in known], float)
    words = sorted(df)
    place = {w: j for j, w in enumerate(words)}
    counts = np.zeros((len(docs), len(words)))
    for i, bag in enumerate(bags):
        for w, n in bag.items():
            counts[i, place[w]] = n
    raw = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * [np.log((1 + len(docs)) / (1 + df[w])) + 1 for w in words]
    raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-30)
    cosines = raw @ raw[known].T
    tells = np.zeros(len(words))
    for j in range(len(words)):
        seen = counts[known, j] > 0
        if 0 < seen.sum() < len(known):
            r = np.corrcoef(seen, y)[0, 1]
            tells[j] = abs(r) if len(known) * r * r >= 23.93 else 0.0
    telling = (raw * tells) @ raw[known].T / np.maximum(cosines, 1e-30)
    prior = (y.sum() + 1) / (len(y) + 2)
    bare = np.array([not bags[i] for i in known])
    without = (y[bare].sum() + 2 * prior) / (bare.sum() + 2)

    def vote(i):
        c = np.where(np.array([docs[k][0] == docs[i][0] for k in known]), 0.0, cosines[i])
        best = np.argsort(-c, kind="stable")[:25]
        best = best[c[best] > 1e-9]
        if not len(best):
            return None
        weight = (1 + 1000 * telling[i, best]) / (1.05 - np.minimum(c[best], 1))
        return (weight @ y[best] + 2 * prior) / (weight.sum() + 2)

    own = [(v, labels[docs[i][0]]) for i in known if (v := vote(i)) is not None]
    x, t = np.log([v / (1 - v) for v, _ in own]), np.array([label for _, label in own], float)
    share = (y.sum() + 1) / (len(y) + 2)
    target = share + 0.75 * (0.5 - share)
    each = np.where(t > 0, target / t.mean(), (1 - target) / (1 - t.mean()))
    a, b = 1.0, 0.0
    for _ in range(100):  # logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = each * p * (1 - p) + 1e-6
        step = np.linalg.solve([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]], [(each * (p - t) * x).sum(), (each * (p - t)).sum()])
        a, b = a - step[0], b - step[1]
    votes = [vote(i) for i in range(len(docs))]
    return [1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b))) if v is not None else (prior if bags[i] else without) for i, v in enumerate(votes)], cosines


def test_toxicity_scores_against_dense_vectors(spark):
    rows = labelled_corpus(200)
    copied = next(r for r in rows if not held(r[0]) and not r[4])
    rows += [(700, copied[1], "s", 1, 0), (701, copied[1] + " " + " ".join(f"zyzzyva{chr(97 + k % 26)}{chr(97 + k // 26)} quokka" for k in range(300)), "s", 1, 0), (702, "zyzzyva", "s", 1, 0), (703, None, "s", 1, 0), (704, "?!", "s", 1, 0)]
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels.filter("doc_id < 700")).collect()}
    want, cosines = toxicity_by_hand([(r[0], r[1]) for r in rows], {r[0]: r[4] for r in rows if r[0] < 700})
    assert np.allclose([got[r[0]].score for r in rows], want, atol=2e-3)
    assert got[700].evidence[0].doc_id == copied[0] and abs(got[700].evidence[0].cosine - 1) < 1e-5
    assert got[701].evidence[0].doc_id == copied[0] and got[701].evidence[0].cosine < 0.7 and got[702].evidence == [] and got[703].score == got[704].score
    at = {r[0]: i for i, r in enumerate(rows)}
    known = [r[0] for r in rows if r[0] < 700 and not held(r[0])]
    for i in (3, 50, 701):
        assert all(abs(e.cosine - cosines[at[i], known.index(e.doc_id)]) < 1e-5 for e in got[i].evidence) and len(got[i].evidence) == 3


def test_toxicity_of_very_long_and_repeated_texts(spark):
    rows = labelled_corpus(150)
    long = " ".join(r[1] for r in rows[:40]) * 90  # over a million characters
    rows += [(800, long, "s", 1, 0), (3, "another text", "s", 1, 0), (3, "another text", "s", 1, 0)]
    docs, labels = tables(spark, rows)
    got = toxicity.toxicity_scores(docs, labels.dropDuplicates(["doc_id"])).collect()
    assert len(got) == len(rows) and len(long) > 10**6 and len({r.score for r in got if r.doc_id == 3}) <= 2


def index_of(vectors, y, terms, block):
    owner = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    cols, weights = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
    return toxicity.BlockMaxIndex(np.arange(len(vectors)), y, owner, cols, weights, np.bincount(cols, minlength=terms), block)


@pytest.mark.parametrize("block", [1, 4, 16, 1000])
def test_index_is_exact_and_skips_postings(block):
    rng = np.random.default_rng(0)
    n, terms = 700, 80
    vectors = []
    for i in range(n):
        t = np.sort(rng.choice(terms // 2, int(rng.integers(0, 12)), replace=False)) + (i % 2) * terms // 2  # two languages
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w) if len(t) else w))
    vectors += [vectors[5]] * 40  # ties at the cut
    index = index_of(vectors, rng.integers(0, 2, len(vectors)), terms, block)
    dense = np.zeros((len(vectors), terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    shares = []
    for i in range(0, len(vectors), 7):
        for skip in (None, i):
            found, cosine, read = index.nearest(*vectors[i], 25, skip)
            scores = dense @ dense[i]
            if skip is not None:
                scores[i] = -1
            want = np.sort(scores[scores > 1e-9])[::-1][:25]
            assert np.allclose(cosine, want, atol=1e-6) and np.allclose(scores[index.ids[found]], cosine, atol=1e-6)
            shares.append(read)
    assert np.mean(shares) < (0.9 if block <= 16 else 1.01) and max(shares) <= 1


def test_terms_are_letter_runs():
    texts = ["Ab, ab-cd 12 É", "", "x"]
    owner, terms, counts = toxicity.term_counts(*text_bytes(pa.array(texts)))
    assert owner.tolist() == [0, 0, 0, 2] and sorted(counts.tolist()) == [1, 1, 1, 2] and len(set(terms.tolist())) == 4


def test_word_vectors_are_sums_over_all_texts(spark):
    docs = spark.createDataFrame([("ab cd",), ("ab cd",), ("cd! ab",)], "text string")
    one, many = (quality.word_vectors(docs.repartition(k)) for k in (1, 3))
    assert np.allclose(one, many) and ((one**2).sum(axis=1) > 0.99).sum() >= 2


# -- the pipeline -------------------------------------------------------------------------------------------------


def windows_removed(rows):
    """(id, text) without later copies of three-line windows."""
    seen, out = set(), []
    for i, text in sorted(rows):
        ls = text.split("\n")
        gone = set()
        for p in range(len(ls) - 2):
            w = "\n".join(ls[p : p + 3])
            if re.search(r"\S", w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        kept = [x for p, x in enumerate(ls) if p not in gone]
        if kept or not gone:
            out.append((i, "\n".join(kept)))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = labelled_corpus(240)
    shared = "\n".join(f"shared line {k} of terms and more words" for k in range(4))
    extra = []
    for k, (i, text, source, q, x) in enumerate(rows[:60]):
        words = text.split()
        kind = k % 4
        if kind == 0:
            extra.append((1000 + i, text, source, q, x))
        elif kind == 1:
            words[0] = "altered"
            extra.append((1000 + i, " ".join(words), source, q, x))
        elif kind == 2:
            extra.append((1000 + i, text + "\n" + shared + "\nend " + str(rng.integers(10**9)), source, q, x))
    rows += [*extra, (5000, "", "s0", 1, 0), (5001, "a\nb\nc", "s1", 1, 0), (5002, "a\nb\nc", None, 1, 0)]
    docs, labels = tables(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[2] for r in rows}

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = corpus_pipeline.keep_quality(spark, stage, str(tmp_path))
    kept = {r.doc_id: r.text for r in stage.collect()}
    predicted = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    assert set(kept) == {i for i, p in predicted.items() if p == 1} and all(kept[i] == text[i] for i in kept)
    want = dict(windows_removed(list(kept.items())))
    stage = corpus_pipeline.dedup_lines(spark, stage, str(tmp_path))
    got = {r.doc_id: r for r in stage.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    ids = sorted(want)
    first = [i for i, root in zip(ids, groups([shingles(want[i]) for i in ids]), strict=True) if ids[root] == i]
    stage = corpus_pipeline.dedup_documents(spark, stage, str(tmp_path))
    assert sorted(r.doc_id for r in stage.collect()) == first and stage.columns == corpus_pipeline.COLUMNS
    n = collections.Counter(source[i] or "" for i in first)
    total = sum(n.values())
    rate = {s: c**0.5 / sum(v**0.5 for v in n.values()) * total / c for s, c in n.items()}

    def count(i):
        import hashlib

        lam = rate[source[i] or ""]
        m = max(1, int(np.ceil(lam / mixing.PIECE)))
        out = 0
        for k in range(m):
            u = int(hashlib.md5(f"17:{i}:{k}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = float(np.exp(-lam / m))
            j = 0
            while c <= u and j < 400:
                j += 1
                p *= lam / m / j
                c += p
                out += 1
        return out

    copies = {i: c for i in first if (c := count(i))}
    assert len(bag("a b")) == 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = {i: len(x) + 1 for i, x in zip(copies, reference_ids([want[i] for i in copies]), strict=True)}
    tokens_out = collections.Counter()
    for r in out:
        tokens_out[r.doc_id] += r.length
    assert tokens_out == {i: lengths[i] * c for i, c in copies.items()}
    fill = collections.defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= sum(tokens_out.values()) / 2048 * 1.1 + 1 and packing.LONG < 1 and len(_vocabulary()) == 2


def test_pipeline_near_dedup_takes_links_from_80_percent(spark):
    rng = np.random.default_rng(11)
    rows, planted = [], []
    for k in range(24):
        words = [f"w{x}" for x in rng.integers(10**6, size=100)]
        rows.append((2 * k, " ".join(words), "s", 1, 0))
        for at in (30, 70)[: k % 3]:  # of 96 shingles 5 change with each word: 0.90 with one, 0.81 with two, 1 with none
            words[at] = f"x{rng.integers(10**9)}"
        rows.append((2 * k + 1, " ".join(words), "s", 1, 0))
        a, b = (shingles(r[1]) for r in rows[-2:])
        planted.append(len(a & b) / len(a | b))
    assert sum(0.8 <= x < 0.85 for x in planted) == 8
    words = [f"v{x}" for x in range(100)]  # 76 of 96 shingles are left: 0.66
    rows += [(100, " ".join(words), "s", 1, 0), (101, " ".join("y" if i in (10, 30, 50, 70) else w for i, w in enumerate(words)), "s", 1, 0)]
    want = [rows[i][0] for i, root in enumerate(groups([shingles(r[1]) for r in rows], 80)) if root == i]
    docs, _ = tables(spark, rows)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == want
    assert len(want) == 26


def test_stages_with_odd_rows(spark, tmp_path):
    """Null ids and texts, empty texts, repeated rows, a long text, extra columns; and an empty table."""
    rows = labelled_corpus(120)
    long = "\n".join(f"row {k} of a long text with words {k * 7919 % 1000}" for k in range(40_000))
    odd = [(None, "a text without an id", "s0", 1, 0), (None, None, None, 1, 0), (3000, None, "s1", 1, 0), (3001, "", "s1", 1, 0), (3002, long, "s1", 1, 0), (3003, "one\ntwo\nthree", "s1", 1, 0), (3003, "one\ntwo\nthree", "s1", 1, 0), (3003, "other text of this id", None, 1, 0)]
    docs, _ = tables(spark, rows + odd)
    _, labels = tables(spark, rows)
    docs = docs.withColumns({c: F.lit("x") for c in EXTRA})
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert len(long) > 10**6
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes, name
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "quality classifier":
            scored = {(r.doc_id, r.text_md5): r.predicted for r in quality.quality_scores(docs, labels).collect()}
            import hashlib

            assert sorted(map(str, got)) == sorted(str((r[0], r[1])) for r in rows + odd if scored[r[0], hashlib.md5((r[1] or "").encode()).hexdigest()] == 1)
        elif name == "line dedup":
            assert len(got) == before and dict(got)[3002] == long and got.count((3000, None)) == 1 and got.count((3001, "")) == 1
        elif name == "MinHash near-dedup":
            assert got.count((3003, "one\ntwo\nthree")) == 1 and (3003, "other text of this id") in got and sum(i is None for i, _ in got) == 2 and (3000, None) in got
        else:
            assert set(got) <= {(r[0], r[1]) for r in rows + odd}
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert packed.filter("doc_id is null").count() == 2 and packed.filter("doc_id = 3003").count() == 3
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), str(tmp_path)).count() == 0


def quality_by_hand(docs, labels):
    """Scores of (id, text) rows from word vectors summed word by word; the network is fitted by the operator's fit()."""
    index = quality.index_vectors()
    words = []
    for _, t in docs:
        slots, _ = quality.word_slots(*text_bytes(pa.array([t or ""])))
        words.append(slots.tolist())
    table, seen = np.zeros((1 << quality.WORD_BITS, quality.DIMENSIONS)), np.zeros(1 << quality.WORD_BITS)
    for w in words:
        for i, slot in enumerate(w):
            seen[slot] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                if j != i:
                    table[slot] += index[w[j]]
    table -= np.outer(seen, table.sum(axis=0) / seen.sum())
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-30)
    x = []
    for (_, t), w in zip(docs, words, strict=True):
        v = table[w] if w else np.zeros((0, quality.DIMENSIONS))
        mean = v.mean(axis=0) if w else np.zeros(quality.DIMENSIONS)
        square = np.sqrt((v * v).mean(axis=0)) if w else np.zeros(quality.DIMENSIONS)
        x.append([*mean, *square, len(set(w)) / len(w) if w else 0.0, np.log1p(len(w)), np.log1p(len((t or "").encode())), np.linalg.norm(mean)])
    x = np.array(x)
    learn = sorted(i for i, (d, _) in enumerate(docs) if d in labels and not held(d))
    return quality.probability(quality.fit(x[learn], np.array([labels[docs[i][0]] for i in learn], float)), x)


def test_quality_scores_against_vectors_by_hand(spark):
    rows = [*labelled_corpus(150), (900, None, "s", 1, 0), (901, "", "s", 1, 0), (902, "word " * 200_000, "s", 1, 0)]
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels.filter("doc_id < 900")).collect()}
    want = quality_by_hand([(r[0], r[1]) for r in rows], {r[0]: r[3] for r in rows if r[0] < 900})
    assert np.allclose([got[r[0]] for r in rows], want, atol=0.02) and np.corrcoef([got[r[0]] for r in rows], want)[0, 1] > 0.999
