"""What a task or the driver holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textmill.functions import vectors
from textmill.llm import phrases, quality
from textmill.llm.scratch import batches_of
from textmill.operators import ranking, search


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def some_text(n):
    return " ".join(f"w{i * i % 997}" for i in range(n))


def test_encode_makes_objects_of_one_batch_only(spark):
    class Whole:
        """A column that can be cut, but not turned into Python objects as a whole."""

        data = pa.array(["a b", None, "c", "d", "e"])

        def __len__(self):
            return 5

        def slice(self, i, n):
            assert n == 2
            return self.data.slice(i, n)

    encoder = vectors.HashingEncoder(8)
    (got,) = vectors.encode(encoder, 2).func(iter([Whole()]))
    assert got.to_pylist() == encoder.encode(["a b", "", "c", "d", "e"])


def test_word_contexts_and_pooling_work_on_small_parts():
    texts = pa.RecordBatch.from_pydict({"doc_id": [0] * 60, "text_md5": ["x"] * 60, "text": [some_text(4000)] * 60})
    table = type("B", (), {"value": np.zeros((1 << quality.WORD_BITS, quality.DIMENSIONS), np.float32)})
    for run in (quality._context, quality._pooler(table)):
        assert peak(lambda run=run: list(run(iter([texts]))))[1] < 90


def test_inverted_lists_hold_little_beside_their_positions():
    texts, langs = pa.array([some_text(3000)] * 500), pa.array(["en", "de"] * 250)
    got, most = peak(lambda: phrases.inverted_lists(texts, langs))
    assert got["sizes"].sum() == len(got["positions"]) == 3000 * 500
    assert most < 90


def test_a_block_of_phrases_is_small_and_keeps_its_words_out_of_the_cogroup(spark, monkeypatch):
    # one Arrow batch of 24 MB would be one or two blocks of 12 MB; a block's merge joins take many times its positions
    text = some_text(4000)
    docs = spark.createDataFrame([(24 * 2**20 // len(text),)], "n int")
    docs = docs.select(F.explode(F.sequence(F.lit(1), "n")).alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang")).coalesce(1)

    def sent(batches):
        for batch in batches:
            assert sum(len(t) for t in batch.column("text").to_pylist()) < 2 * phrases.BATCH_BYTES
            yield batch

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with batches_of(spark, phrases.BATCH_BYTES):
        rows = docs.mapInArrow(sent, docs.schema).mapInArrow(phrases._blocks, phrases._BLOCK).select("words", "sizes", "positions").collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert sum(sum(r.sizes) for r in rows) == 4000 * docs.count() == sum(len(r.positions) for r in rows) // 4
    assert max(len(r.positions) for r in rows) < 4 << 20
    big = max(rows, key=lambda r: len(r.positions))
    lists = pa.table({"block": [0], "ids": [list(range(len(big.sizes)))], "sizes": [big.sizes], "positions": pa.array([bytes(big.positions)], pa.binary())})
    pairs, most = peak(lambda: list(phrases._pairs(lists.to_batches())))
    assert most < 60
    pairs = pa.Table.from_batches(pairs).select(["block", "a", "b"])
    assert peak(lambda: phrases._triples(lists, pairs))[1] < 60
    keep = phrases._keep

    def only_numbers(left, right):
        assert not left.num_rows or left.column_names == ["block", "sizes", "positions"]
        return keep(left, right)

    monkeypatch.setattr(phrases, "_keep", only_numbers)
    got = phrases.collocations(docs.limit(20), top=3)
    assert got.count() == 3 and {r.n for r in got.collect()} == {4000 * 20}


def test_cross_scores_keep_columns_of_both_sides(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 1.0], None)], "query_id long, vector array<double>, ql int")
    c = spark.createDataFrame([(1, [1.0, 1.0], "x"), (3, [0.0, 1.0], None)], "doc_id long, vector array<double>, dl string")
    got = search.cross_scores(q, c, different=True, keep=["dl", "ql"])
    assert got.columns == ["query_id", "doc_id", "score", "dl", "ql"]
    assert sorted((r.query_id, r.doc_id, r.ql, str(r.dl)) for r in got.collect()) == [(1, 3, 7, "None"), (2, 1, None, "x"), (2, 3, None, "None")]


def test_rerank_reads_all_pairs_once(spark):
    rows = [(q, d, float(d)) for q in (1, 2) for d in range(6)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, score double").mapInArrow(lambda batches: batches, "query_id long, doc_id long, score double")
    texts = spark.createDataFrame([(d, "q", "" if d == 4 else "t", d) for d in range(6)], "doc_id long, query_text string, doc_text string, l int")
    out = ranking.rerank(scored, texts, F.col("l") * 10.0, depth=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the rest reads the written heads
    assert sorted((r.query_id, r.doc_id, r.score, r.stage) for r in out.collect()) == [(q, d, s, t) for q in (1, 2) for d, s, t in [(0, 0.0, 2), (1, 1.0, 2), (2, 2.0, 2), (3, 30.0, 1), (5, 50.0, 1)]]
