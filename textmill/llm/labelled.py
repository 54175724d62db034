"""Training rows of a labels table: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id", modulus: int = 5, part: int = 0):
    """Whether crc32 of the id as text falls into the part that is never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == part, F.lit(True))


def training_sample(labels: DataFrame, target: str, bound: int, id_col: str = "doc_id", seed: int = 5, by_label: bool = False) -> tuple[DataFrame, float]:
    """Rows (doc_id, y) to learn from, about `bound` of the labelled ids that aren't held out, evenly by a hash; and the
    share of label 1 among all of them.

    by_label takes as many of each label, and more of one where the other has fewer. Null ids and null labels are left
    out; an id with several labels has the largest, 1 if it isn't 0."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(target).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(F.col(target).cast("int")) != 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = (ones + 1) / (ones + zeros + 2)
    if ones + zeros <= bound:
        return rows, share
    asked = {1: bound * ones / (ones + zeros), 0: bound * zeros / (ones + zeros)}
    if by_label:
        few = min(ones, zeros, bound / 2)
        asked = {1: few if ones <= zeros else bound - few, 0: few if zeros < ones else bound - few}
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("y") == 1, asked[1] / max(ones, 1)).otherwise(asked[0] / max(zeros, 1))
    return rows.filter(place < limit), share


def one_text_each(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) with the least text of each id: what is learned from is bounded by ids, however often one
    repeats. The least is a partial aggregate."""
    rest = [c for c in rows.columns if c not in ("doc_id", "text")]
    least = rows.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("least"))
    return least.select("doc_id", "least.text", *[F.col(f"least.{c}").alias(c) for c in rest])


#: A bound that no logit comes near.
WIDE = 1e6


def bounded(logits, bound: float):
    """Logits within (-bound, bound), in the same order; small ones stay as they are."""
    import numpy as np

    return bound * np.tanh(logits / bound)


def temperature(logits, y, bound: float = WIDE) -> float:
    """The temperature with which sigmoid(bounded(logit / temperature)) has the least log loss on held-back rows."""
    import numpy as np

    grid = np.exp(np.linspace(np.log(0.2), np.log(8.0), 80))
    loss = [np.mean(np.logaddexp(0.0, bounded(np.where(y > 0, -logits, logits) / t, bound))) for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(y) else 1.0
