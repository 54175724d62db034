"""Prefix trie, URL filter and collocations against brute force, and their defined results for odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import phrases, trie, urls
from textmill.llm.queries import URL_RULES

from .test_small_ops import EXTRA

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    turns = {c: tuple(t[3] for t in sorted(ts)) for c, ts in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole = turns.get(base, ())[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(p)) for p, cs in members.items())


def trie_rows(got):
    return sorted(tuple(r[c] for c in TRIE) for r in got.collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def talk(seed, n=400):
    """Conversations of few different turns, a fourth of them alike, some with no turns of their own left."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(5 * n, n, replace=False).tolist():
        if rng.random() < 0.25:
            rows += [(c, t, "user", f"hot {t}") for t in range(8)]
        else:
            rows += [(c, t, str(rng.choice(["user", "bot"])), "é" * int(rng.integers(0, 4))) for t in range(int(rng.integers(1, 9)))]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_trie_over_ranges(spark, ranges):
    rows = talk(ranges)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert trie_rows(trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS))) == trie_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_trie_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (3, None, None, None), (3, 1, "u", "a"), (3, 1, "u", "a"), (100, 0, "u", "a,b"), (101, 0, "u,a", "b"), (200, None, "u", ""), (205, 7, "", "u"), (-7, 0, "u", "a"), (-100, 0, "v", "b" * 100_000)]
    rows += [(310, k, "u", f"turn {k % 3}") for k in range(700)] + [(300, k, "u", f"turn {k % 3}") for k in range(3)]
    docs = spark.createDataFrame(rows, CONVERSATIONS)
    assert trie_rows(trie.prefix_trie(docs.withColumns({c: F.lit("x") for c in [*EXTRA, "edge", "part", "turns"]}))) == trie_by_hand(rows)
    assert trie.prefix_trie(docs.limit(0)).count() == 0


def test_common_turns():
    a = "".join(hashlib.md5(bytes([i])).hexdigest() for i in range(9))
    for k in range(10):
        assert trie.common_turns(a, a[: 32 * k] + hashlib.md5(b"other").hexdigest()) == k and trie.common_turns(a[: 32 * k], a) == k


def judge_by_hand(rows, rules, rounds, percent=50):
    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]

    out, seeds, links, hosts = [], {"trust": collections.Counter(), "distrust": collections.Counter()}, collections.Counter(), set()
    for i, url, html in rows:
        host, path = parts(url)
        fits = [(len(r), len(r.partition("/")[0]), r, v) for r, v in rules if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        rule, verdict = max(fits)[2:] if fits else (None, None)
        out.append((i, host, path, rule, verdict))
        if verdict:
            seeds["trust" if verdict == "allow" else "distrust"][host] += 1
        if host:
            hosts.add(host)
            for name in {re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(".")) for x in re.findall(r"[A-Za-z0-9_.-]+", html or "") if "." in x} - {host}:
                links[host, name] += 1
    total = {}
    for kind in seeds:
        ways = collections.defaultdict(dict)
        for (a, b), n in links.items():
            if b in hosts:
                ways[a if kind == "trust" else b][b if kind == "trust" else a] = n
        every = sum(seeds[kind].values())
        step = {h: n * urls.UNITS // every for h, n in seeds[kind].items()}
        rank = collections.Counter(step)
        for _ in range(rounds):
            after = collections.Counter()
            for a, m in step.items():
                for b, n in ways[a].items():
                    after[b] += m * n * urls.DAMPING // (100 * sum(ways[a].values()))
            step = after
            rank.update(step)
        total[kind] = rank
    return sorted(((i, h, p, r, v or ("block" if total["distrust"][h] * (100 - percent) > total["trust"][h] * percent else "allow"), total["trust"][h], total["distrust"][h]) for i, h, p, r, v in out), key=repr)


PAGES = "page_id long, url string, html string"


def web(seed=0, n=300):
    rng = np.random.default_rng(seed)
    hosts = [f"h{i}.{d}" for i in range(12) for d in ("example.com", "example.net", "site.org", "other.de")]
    pick = lambda: hosts[min(int(rng.exponential(6)), len(hosts) - 1)]
    url = lambda h: f"http{'s' * int(rng.integers(0, 2))}://{h if rng.random() < 0.8 else h.upper()}{rng.choice(['', '/', '/en/1', '/de/2?x=/fr/', '/fr/3#a', '/english', '?q=1'])}"
    rows = [(i, url(pick()), "see " + " ".join(f'<a href="https://{pick()}/en/">x</a> or {pick()}.' for _ in range(int(rng.integers(0, 4))))) for i in range(n)]
    return [*rows, (None, None, None), (n, "no scheme", "h1.example.com"), (n, "", None), (n + 1, "ftp://h1.example.com://h2", "x" * 200_000 + " h0.site.org" + " a.b" + ".c" * 100_000)]


def judged(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()), key=repr)


def test_urls_against_brute_force(spark):
    rows = web()
    pages = spark.createDataFrame(rows, PAGES)
    want = judge_by_hand(rows, URL_RULES, 5)
    assert judged(urls.judge_urls(pages.withColumns({c: F.lit("x") for c in [*EXTRA, "host", "path", "rule", "hit", "trust"]}), URL_RULES, rounds=5)) == want
    assert {"allow", "block"} == {r[4] for r in want if r[3] is None and r[5] + r[6]}  # the method decides both ways
    table = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    assert judged(urls.judge_urls(pages, table, rounds=5)) == want
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert judged(urls.judge_urls(pages, [], rounds=5)) == judge_by_hand(rows, [("none.example/", "block")], 5)


def test_rules_joined_equal_rules_tried(spark):
    rng = np.random.default_rng(4)
    rules = [*URL_RULES, ("h1.example.com", "block"), ("h2.example.com/en", "allow"), ("h2.example.com/e", "block"), ("com/engl", "allow"), ("h3.site.org/fr/3", "block")]
    rules += [(f"h{i}.other.de/{rng.choice(['en/', 'de/', 'f', ''])}x{i}", "block") for i in range(80)]
    assert len(rules) > urls.FEW_RULES
    rows = web(1)
    pages = spark.createDataFrame(rows, PAGES)
    assert judged(urls.judge_urls(pages, rules, rounds=2)) == judge_by_hand(rows, rules, 2)


def test_urls_stay_in_the_jvm(spark):
    plan = urls.judge_urls(spark.createDataFrame(web(n=20), PAGES), URL_RULES, rounds=2)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def collocations_by_hand(rows, least=10, percent=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for p, a in found.items():
        if any(100 * b >= percent * a for q, b in found.items() if len(q) == 4 and len(p) == 3 and q[0] == p[0] and p[1:] in (q[1:3], q[2:])):
            continue
        cuts = [(10**6 * a * a // (f[p[:k]] * f[p[0], *p[k:]]), k, f[p[:k]], f[p[0], *p[k:]]) for k in range(2, len(p))]
        s, _, left, right = min(cuts)
        out[p[0]].append((-s, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sayings(seed=0, n=120):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "city", "the", "of", "Ünï", "x y", "a-b", "é", " "] + [f"w{i}" for i in range(60)]
    weights = np.array([8] * 10 + [1] * 60) / 140
    join = lambda: str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.02, 0.03]))
    rows = [("".join(w + join() for w in rng.choice(words, int(rng.integers(0, 60)), p=weights)), str(rng.choice(["en", "fr"]))) for _ in range(n)]
    return [*rows, *[("alpha beta gamma", "en")] * 30, *[("alpha beta", "de")] * 12, ("tic tac " * 5000, None), (None, "en"), ("", "fr"), ("...", None), ("tic tac tic", "und")]


@pytest.mark.parametrize("block", [1, 3000, 12 << 20])
def test_collocations_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rows = sayings(block % 7)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    docs = docs.withColumns({c: F.lit("x") for c in [*EXTRA, "block", "a", "b", "f", "word", "phrase"]})
    assert phrase_rows(phrases.collocations(docs)) == collocations_by_hand(rows)
    assert phrase_rows(phrases.collocations(docs, least=4, percent=80, top=7)) == collocations_by_hand(rows, 4, 80, 7)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(3 * 10**12, 3 * 10**12 + 1, 3 * 10**12 + 7), (10**15, 10**15, 10**15), (7, 10**13, 9)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(F.expr(phrases._score("a", "l", "r"))).collect()] == [10**6 * a * a // (left * right) for a, left, right in rows]
