"""Dense vectors: cosine, encoders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Products of whole arrays; cast to double first, so that sums don't depend on the element type."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


class Encoder(Protocol):
    """Anything that turns a list of texts into equally long vectors."""

    name: str

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEncoder:
    """A deterministic stand-in for a sentence model: signed hashed words, unit length. No model is shipped here."""

    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hashing-{size}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                code = zlib.crc32(word.encode())
                out[i, code % self.size] += 1.0 if code >> 31 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype("float32").tolist()


def encode(encoder: Encoder, batch: int = 64):
    """An Arrow function from text to vector. The encoder is sent once a task and called on `batch` texts at a time; no more
    of them than that are Python objects at once, however many rows Spark sends together."""
    kind = pa.list_(pa.float32())

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            made = [pa.array(encoder.encode([t or "" for t in texts.slice(i, batch).to_pylist()]), kind) for i in range(0, len(texts), batch)]
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    return run
