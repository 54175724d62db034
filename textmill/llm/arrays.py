"""Byte-level helpers on Arrow batches: whole texts as one numpy byte array, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that powers have inverses modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the hash base, or of its inverse, modulo 2**64."""
    key = "inv" if inverse else "pow"
    got = _powers.get(key)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        got = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array with n+1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text and `rows` rows; a longer text comes alone. Nothing is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(length.astype(np.int64) + limit // rows) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def prefix_codes(codes: np.ndarray) -> np.ndarray:
    """Sums of codes times powers of the base; hash_spans() reads spans from it."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """prefix_codes() of bytes."""
    return prefix_codes(BYTE_CODES[data])


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, alike for like content and length wherever they stand."""
    inverse = powers(len(prefix), inverse=True)
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes for which `inside` (a table of 256) holds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_word = inside[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    first = of_word.copy()
    first[1:] &= ~of_word[:-1] | fresh[1:-1]
    last = of_word.copy()
    last[:-1] &= ~of_word[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_codes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in order, and where each text's words begin."""
    starts, ends, doc = word_spans(data, offsets, inside)
    return hash_spans(prefix_hash(data), starts, ends), np.searchsorted(doc, np.arange(len(offsets)))


#: Words are runs of bytes outside \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its word shingles (A-Z lower-cased).

    A text of 1 to size-1 words has its whole word sequence as the only shingle; one without words has none."""
    low = LOWER_ASCII[data]
    starts, ends, doc = word_spans(low, offsets, NOT_SPACE)
    words = hash_spans(prefix_hash(low), starts, ends)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    coef = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    rolled = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * coef[k]
    rolled = mix64(rolled + np.uint64(size))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * coef[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
