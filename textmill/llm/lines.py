"""Line dedup by overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import quoted, whole_row, without

_LEAST = -(2**63)


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """docs with its text cleared of repeated line windows, plus the columns n_lines and n_removed.

    A window is `size` consecutive lines (split at line feeds) with at least one character that isn't blank. The first
    window of its content in the order (id, text digest, position) stays; each later one, in another document or in the
    same, covers its lines, and all covered lines of a document are removed together. In a run of like lines windows
    overlap, so the run shrinks to what its first line leaves.

    Windows travel as (digest, id, position) only. The earliest place of a digest is a partial aggregate, so a passage
    that a third of all documents share is a single row a task before the shuffle, and the join back can be split.

    Defined results: a null text stays null with 0 lines; a text of fewer than `size` lines, the empty one included, is
    unchanged; a null id counts as the least id; rows alike in id and text count as one document and are treated alike;
    other columns pass through, whatever their names, but columns named n_lines or n_removed, in any case, are replaced;
    an empty table stays empty. Long texts count whole."""
    names = without(docs, "n_lines", "n_removed")
    text = F.col(quoted(text_col))
    key = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(_LEAST)).alias("id")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("copy")
    lines = F.split(text, "\n", -1)
    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: F.array_join(F.slice("lines", i + 1, F.lit(size)), "\n"))
    spread = docs.select(key, digest, lines.alias("lines")).filter(F.size("lines") >= size)
    spread = spread.select("id", "copy", F.posexplode(windows).alias("pos", "window")).filter(F.regexp_like("window", F.lit(r"\S")))
    spread = spread.select("id", "copy", "pos", F.unhex(F.md5("window")).alias("key"))
    place = F.struct("id", "copy", "pos")
    first = spread.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    later = spread.join(first, "key").filter(place != F.col("first"))
    spans = later.groupBy("id", "copy").agg(F.collect_set("pos").alias("at"))
    out = docs.select(whole_row(docs.select(*map(quoted, names))), key, digest).join(spans, ["id", "copy"], "left")
    old = F.col(f"row.{quoted(text_col)}")
    out = out.select("row", "at", F.split(old, "\n", -1).alias("lines"))
    covered = F.flatten(F.transform("at", lambda p: F.sequence(p, p + size - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = out.withColumn("left", F.when(F.col("at").isNotNull(), left))
    new = F.when(F.col("at").isNull(), old).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    columns = [new.alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in names]
    n_lines = F.when(old.isNull(), 0).otherwise(F.size("lines")).alias("n_lines")
    return out.select(*columns, n_lines, F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).alias("n_removed"))
