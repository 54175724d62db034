"""Exact order statistics by radix selection: histograms of the bits of scores, no sort and no kept copy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a pass settles: a histogram has 2**DIGIT bins, and 64 / DIGIT passes give a double.
DIGIT = 16
_BINS = 1 << DIGIT
_SIGN = np.uint64(1 << 63)


def sortable(scores: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order: -0.0 is 0.0, and all NaN are one value over infinity."""
    plain = np.where(np.isnan(scores), np.nan, scores + 0.0)
    bits = plain.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_sortable(bits: int) -> float:
    raw = np.uint64(bits)
    return float(np.array([raw ^ _SIGN if raw & _SIGN else ~raw], np.uint64).view(np.float64)[0])


def _histograms(prefixes: list[int], settled: int):
    """How many scores go on with each digit, for each beginning of bits in `prefixes`; one histogram each a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(prefixes), _BINS), np.int64)
        for batch in batches:
            scores = batch.column("score").drop_null().to_numpy(zero_copy_only=False)
            if not len(scores):
                continue
            bits = sortable(scores.astype(np.float64))
            digit = ((bits >> np.uint64(64 - settled - DIGIT)) & np.uint64(_BINS - 1)).astype(np.int64)
            for i, prefix in enumerate(prefixes):
                mine = digit if settled == 0 else digit[(bits >> np.uint64(64 - settled)) == np.uint64(prefix)]
                counts[i] += np.bincount(mine, minlength=_BINS)
        which, bins = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts[which, bins])], names=["which", "bin", "n"])

    return run


def _pass(scores: DataFrame, prefixes: list[int], settled: int) -> np.ndarray:
    """The summed histograms: 2**DIGIT numbers for each prefix, however many rows there are."""
    rows = scores.mapInArrow(_histograms(prefixes, settled), "which int, bin int, n long").groupBy("which", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(prefixes), _BINS), np.int64)
    counts[rows["which"].to_numpy(), rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return counts


def elements(scored: DataFrame, places, score: str = "score") -> tuple[int, dict[int, float]]:
    """(n, {place: value}): the number of scores that aren't null, and the values at the places (from 0, in ascending
    order) that the function places(n) names.

    A pass reads the scores and counts them by their next 16 bits; the bin that holds a place is followed by the next
    pass. Four passes give the value exactly, whatever the distribution and however many ties there are. What comes to
    the driver is a histogram of 65,536 bins for each different beginning, two a quantile at most. NaN is the greatest."""
    scores = scored.select(F.col(score).cast("double").alias("score"))
    counts = _pass(scores, [0], 0)
    n = int(counts.sum())
    asked = sorted(set(places(n))) if n else []
    state = {p: (0, p) for p in asked}  # place: (bits so far, place among the scores that begin so)
    prefixes = [0]
    for settled in range(DIGIT, 64 + DIGIT, DIGIT):
        found = {}
        for p, (prefix, rest) in state.items():
            sums = np.cumsum(counts[prefixes.index(prefix)])
            at = int(np.searchsorted(sums, rest, "right"))
            found[p] = (prefix << DIGIT | at, rest - int(sums[at - 1]) if at else rest)
        state = found
        if settled == 64 or not state:
            break
        prefixes = sorted({prefix for prefix, _ in state.values()})
        counts = _pass(scores, prefixes, settled)
    return n, {p: from_sortable(prefix) for p, (prefix, _) in state.items()}


def quantiles(scored: DataFrame, qs: list[float], score: str = "score") -> list[float | None]:
    """Quantiles with linear interpolation between neighbours; None without scores."""
    ends = lambda q, n: (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))
    n, values = elements(scored, lambda n: [p for q in qs for p in ends(q, n)], score)
    if not n:
        return [None] * len(qs)
    out = []
    for q in qs:
        low, high = (values[p] for p in ends(q, n))
        out.append(low if low == high else low + (high - low) * (q * (n - 1) - math.floor(q * (n - 1))))
    return out
