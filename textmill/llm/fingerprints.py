"""Document fingerprints by consistent weighted sampling: equal samples as often as generalised Jaccard similarity says."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import GOLDEN, LOWER_ASCII, NOT_SPACE, hash_spans, mix64, prefix_hash, text_bytes, word_spans
from .scratch import written

SAMPLES = 64
#: A worker keeps the random numbers of up to 2**CACHE_BITS terms.
CACHE_BITS = 15
#: Texts are handled in blocks of about so many characters.
BLOCK_CHARS = 500_000


def _uniform(terms: np.ndarray, salt: int) -> np.ndarray:
    steps = mix64((np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(salt << 16)) * GOLDEN)
    return ((mix64(terms[:, None] ^ steps[None, :]) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def term_numbers(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term and sample: r and c from Gamma(2, 1) and b, uniform; as (ln c - r + r*b, r, b).

    A term of weight w gets t = floor(ln w / r + b), y = exp(r * (t - b)) and the key a = c / (y * exp(r)), so
    ln a = (ln c - r + r*b) - r*t."""
    r = -np.log(_uniform(terms, 1) * _uniform(terms, 2))
    c = -np.log(_uniform(terms, 3) * _uniform(terms, 4))
    b = _uniform(terms, 5)
    return (np.log(c) - r + r * b).astype(np.float32), r.astype(np.float32), b.astype(np.float32)


class Sampler:
    """Signatures of texts as bags of lower-cased words, weighted by how often they occur."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.full = np.zeros(1 << CACHE_BITS, bool)
        self.numbers = tuple(np.zeros((1 << CACHE_BITS, SAMPLES), np.float32) for _ in range(3))

    def _numbers(self, terms: np.ndarray) -> tuple[np.ndarray, ...]:
        slots = (terms >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        known = self.full[slots] & (self.keys[slots] == terms)
        out = tuple(n[slots] for n in self.numbers)
        new = np.flatnonzero(~known)
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            made = term_numbers(terms[part])
            for target, values in zip(out, made, strict=True):
                target[part] = values
            free = ~self.full[slots[part]]
            for target, values in zip(self.numbers, made, strict=True):
                target[slots[part[free]]] = values[free]
            self.keys[slots[part[free]]] = terms[part[free]]
            self.full[slots[part[free]]] = True
        return out

    def signatures(self, texts: list[str]) -> np.ndarray:
        """One row of SAMPLES 16-bit values a text; a text without words has a row of zeros, and no other has.

        A sample is the term and t of the least key. The key is a function of both, so its bits stand for them."""
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        data = LOWER_ASCII[data]
        starts, ends, doc = word_spans(data, offsets, NOT_SPACE)
        out = np.zeros((len(texts), SAMPLES), dtype=np.uint16)
        if not len(starts):
            return out
        terms, which = np.unique(hash_spans(prefix_hash(data), starts, ends), return_inverse=True)
        pairs = np.sort(doc * len(terms) + which)
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        weight = np.diff(np.append(first, len(pairs)))
        owner, term = np.divmod(pairs[first], len(terms))
        base, r, b = self._numbers(terms)
        least = np.full((len(texts), SAMPLES), np.inf, dtype=np.float32)
        for lo in range(0, len(term), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            key = base[term[part]]
            often = np.flatnonzero(weight[part] > 1)
            if len(often):
                at = term[part][often]
                step = np.floor(np.log(weight[part][often]).astype(np.float32)[:, None] / r[at] + b[at])
                key[often] -= r[at] * step
            begin = np.flatnonzero(np.concatenate([[True], owner[part][1:] != owner[part][:-1]]))
            here = owner[part][begin]
            least[here] = np.minimum(least[here], np.minimum.reduceat(key, begin, axis=0))
        filled = np.unique(owner)
        bits = mix64(least[filled].view(np.uint32).astype(np.uint64) * GOLDEN)
        out[filled] = np.maximum((bits >> np.uint64(48)).astype(np.uint16), 1)
        return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an estimate of the sum of lesser over the sum of greater weights."""
    return (x == y).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down, in code points) replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Digests travel as bytes; fingerprints() writes them as hex digits in the end.
_SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGE = [("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())]


def _digests(sampler: Sampler, ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Columns of _SCHEMA; following: the next text of each."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    unique = {t: i for i, t in enumerate(dict.fromkeys([*texts, *following]))}
    own = sampler.signatures(list(unique))
    mine, after, new = own[[unique[t] for t in texts]], own[[unique[t] for t in following]], sampler.signatures(changed)

    def written_out(rows: np.ndarray) -> list[bytes]:
        return [r.astype(">u2").tobytes() for r in rows]

    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).digest() for t in changed], written_out(mine), written_out(new), likeness(mine, new), likeness(mine, after)]
    return [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted rows, each with the one after it; then the first and the last row of the task, for the joints."""
    from pyspark import TaskContext

    part, sampler, schema = TaskContext.get().partitionId(), Sampler(), pa.schema([*_ARROW, *_EDGE])
    first, ids, texts, size = None, [], [], 0

    def block(n: int) -> pa.RecordBatch:
        made = _digests(sampler, ids[:n], texts[:n], texts[1 : n + 1])
        return pa.RecordBatch.from_arrays([*made, *[pa.nulls(n, t) for _, t in _EDGE]], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if first is None:
                first = (doc_id, text)
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > BLOCK_CHARS or len(ids) > 2000:
                if len(ids) > 1:
                    yield block(len(ids) - 1)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if first is not None:
        if len(ids) > 1:
            yield block(len(ids) - 1)
        edges = [(first[0], 0, first[1]), (ids[-1], 1, texts[-1])]
        made = [pa.array([e[0] for e in edges], pa.int64()), *[pa.nulls(2, f.type) for f in list(_ARROW)[1:]]]
        yield pa.RecordBatch.from_arrays([*made, pa.array([part, part], pa.int32()), pa.array([e[1] for e in edges], pa.int32()), pa.array([e[2] for e in edges], pa.string())], schema=schema)


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler()
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays(_digests(sampler, [row["doc_id"]], [row["text"]], [row["following"]]), schema=_ARROW)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A fingerprint has SAMPLES samples of 4 hex digits from the bag of lower-cased words: two agree in a sample with the
    probability of their generalised Jaccard similarity (and by chance once in 65,536). The edited text has its last
    half replaced by the start of the next document in ascending id (after the last: the first).

    Texts are shuffled once, into sorted ranges of ids; only the first and last text of each range meet again.

    Defined results: a null text is empty; texts without words agree in all samples among themselves and in none with
    others; a null id sorts first; rows of one id are ordered by the digest of their text; other columns are ignored; one row alone is
    followed by itself; an empty table gives no rows."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = base.withColumn("digest", F.md5("text"))  # rows of one id are spread, too
    sorted_rows = keyed.repartitionByRange(ranges, "doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    walked = written(sorted_rows.mapInArrow(_walk, f"{_SCHEMA}, part int, edge int, text string"), "fingerprints")
    # one row a range: which range comes next, the first one after the last
    parts = sorted(r["part"] for r in walked.filter("edge = 0").select("part").collect())
    order = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, after int")
    last = walked.filter("edge = 1").select("doc_id", "text", "part").join(order, "part")
    start = walked.filter("edge = 0").select(F.col("part").alias("after"), F.col("text").alias("following"))
    joints = last.join(start, "after").select("doc_id", "text", "following").mapInArrow(_joint, _SCHEMA)
    rows = walked.filter("edge is null").select(*[f.name for f in _ARROW]).unionByName(joints)
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
