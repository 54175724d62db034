"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import quoted, whole_row, without

#: Sources up to this number are sent to every executor; beyond it the rates are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A mean above this is drawn as a sum of that many smaller Poisson counts: exp(-mean) stays far from zero.
PIECE = 64.0


def _uniform(*parts: Column | str) -> Column:
    """52 bits of an md5 digest as a number in [0, 1): the same in any SQL engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, exponent: float = 0.5, total: int | None = None) -> DataFrame:
    """Rows (source, n, rate): the mean number of copies of a document of each source.

    The target share of a source is its weight over the sum of weights; without weights it is n ** exponent over the
    sum of these. A source without a weight gets none. The mean size of the mix is `total`, or as many as there are.
    A null source is the source ''; an empty table gives no rows."""
    counts = docs.groupBy(F.coalesce(F.col(quoted(source_col)), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map()
        counts = counts.withColumn("weight", F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0))
    whole = counts.agg(F.sum("weight").alias("weights"), F.sum("n").alias("all"))
    size = F.col("all") if total is None else F.lit(total)
    rate = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * size / F.col("n")).otherwise(0.0)
    return counts.crossJoin(F.broadcast(whole)).select("source", "n", rate.alias("rate"))


def replicate(docs: DataFrame, rate_table: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every document as often as its Poisson count says, in a globally shuffled order, with copy (from 1) and shuffle_key.

    The count is the Poisson distribution function of the source's rate, inverted at a uniform number hashed from the
    seed and the id: the same on every run, however the rows are dealt out. Rows of one id get like counts. The order
    is that of a digest of seed, id and copy, a range-partitioned sort of evenly spread keys: no source gathers anywhere.
    The copies of one document are made one after the other in the task that reads it.

    Defined results: a null source is the source '', a null id hashes as 'null'; null and empty texts are kept like
    others; columns named copy or shuffle_key, in any case, are replaced, all others pass through, whatever their names;
    an empty table stays empty."""
    names = without(docs, "copy", "shuffle_key")
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    table = rate_table.select("source", "rate", pieces.alias("pieces")).withColumn("mean", F.col("rate") / F.col("pieces"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    least = F.exp(-F.col("mean"))

    def grow(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), F.struct(least.alias("p"), F.array(least).alias("c")), grow)["c"]
    table = table.select("source", "pieces", cdf.alias("cdf"))
    if rate_table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")).alias("name")
    base = docs.select(whole_row(docs.select(*map(quoted, names))), name, F.coalesce(F.col(quoted(source_col)), F.lit("")).alias("source"))
    joined = base.join(table, "source")

    def draw(i: Column) -> Column:
        u = _uniform(str(seed), F.col("name"), i)
        return F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), draw), F.lit(0), lambda a, x: a + x)
    copies = joined.select("row", "name", count.alias("n")).filter("n > 0").select("row", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), "name", F.col("copy").cast("string"))))
    return keyed.orderBy("shuffle_key").select("row.*", "copy", "shuffle_key")
