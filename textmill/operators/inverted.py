"""Top k by products of sparse vectors over an inverted index with upper bounds: lists that can't lift anything are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Scores are rounded to DIGITS before they are compared; bounds allow for that and for the order of sums.
DIGITS, SLACK = 9, 1e-8
#: Queries whose lists are sent to the tasks at a time; more are taken in as many blocks.
BLOCK = 256


def index(weights: DataFrame, name: str = "postings") -> DataFrame:
    """Postings (term, block, id, weight) of rows (id, term, weight), written: what top_products() searches.

    A block holds ids of about equally many terms (two blocks for each doubling), so that in a block the weights of a
    term in unit vectors are of a kind and its greatest is a sharp bound. Blocks are few: twice the binary logarithm of
    the longest vector's terms. With a column n_terms, how many an id has, nothing is shuffled."""
    size = F.col("n_terms") if "n_terms" in weights.columns else F.count("*").over(Window.partitionBy("id"))  # of one id's terms
    return written(weights.select("id", "term", "weight", F.floor(2 * F.log2(size)).cast("int").alias("block")).filter("weight > 0"), name)


def products(pairs: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows (q, id, score): whole products of the listed pairs, over 0. What is asked is written, so that Spark knows its
    size: postings are only shuffled if it is large."""
    asked = written(pairs.select("q", "id").join(queries, "q"), "pairs")
    return asked.join(postings.select("id", "term", "weight"), ["id", "term"]).groupBy("q", "id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scores.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_products(queries: DataFrame, postings: DataFrame, k: int, probe: int = 64, block: int = BLOCK) -> DataFrame:
    """Rows (q, id, score, rank, read, postings): for each query (q, term, w) the k ids of the greatest products over 0,
    the lesser id first among equals; how many postings were read for it, and how many its terms have.

    First the rarest lists of a query, about `probe` times k postings, give some ids; the k-th best of their whole
    products is a floor for the answer. In each block a query's lists are put in order of what a posting of them can add
    (its weight times the greatest in the block, over the list's length), long lists of small weights first. Those that
    all together stay under the floor lift no id there by themselves: they are not read, and a block in which that holds
    for all is left out. Ids of the other lists stay if what they have plus
    what the unread lists can add reaches the floor, and get their whole product.

    The result is exact; data decide how much is skipped. About `block` queries at a time go to the postings, which stay
    where they are; products are summed before they travel, so no task holds an id's or a term's rows. Queries without k
    ids over 0 read all of their lists.

    Defined results: weights of 0 or less are left out; a repeated (q, term) adds up; queries without known terms, and
    empty sides, give no rows."""
    parts = max(1, -(-queries.select("q").distinct().count() // block))
    bounds = postings.groupBy("term", "block").agg(F.max("weight").alias("most"), F.count("*").alias("n"))
    bounds = written(bounds, "bounds")
    out = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        found = _top(mine, postings, bounds, k, probe)
        out = found if out is None else out.unionByName(found)
    return out


def _top(queries: DataFrame, postings: DataFrame, bounds: DataFrame, k: int, probe: int) -> DataFrame:
    """top_products() for a number of queries whose lists (q, term, block) can be sent to every task."""
    asked = written(queries.filter("w > 0").groupBy("q", "term").agg(F.sum("w").alias("w")), "asked")
    lists = written(asked.join(bounds, "term").withColumn("adds", F.col("w") * F.col("most")), "lists")
    # probe: the shortest lists, up to the first with which there are enough postings
    seen = F.sum("n").over(Window.partitionBy("q").orderBy("n", "term", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    probed = lists.withColumn("seen", seen).filter((F.col("seen") - F.col("n") < probe * k) & (F.col("n") <= probe * k)).select("q", "term", "block", "w", "n")
    early = postings.join(F.broadcast(probed), ["term", "block"]).groupBy("q", "id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    floors = _best(products(_best(early, 4 * k), asked, postings), k).filter(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    floors = written(floors, "floors")
    by_block = Window.partitionBy("q", "block").orderBy(F.col("adds") / F.col("n"), "term")
    under = F.sum("adds").over(by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    weighed = lists.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("under", under)
    weighed = weighed.withColumn("unread", F.col("under") < F.col("floor") - SLACK)
    weighed = written(weighed.withColumn("rest", F.max(F.when(F.col("unread"), F.col("under"))).over(Window.partitionBy("q", "block"))), "weighed")
    needed = weighed.filter("not unread").select("q", "term", "block", "w", "floor", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    partial = postings.join(F.broadcast(needed), ["term", "block"]).groupBy("q", "id").agg(F.sum(F.col("w") * F.col("weight")).alias("has"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
    reach = written(partial.filter(F.col("has") + F.col("rest") >= F.col("floor") - SLACK), "reach")
    # the k-th best of what is there already may be a higher floor than that of the probe
    higher = _best(reach.select("q", "id", F.col("has").alias("score")), k).filter(F.col("rank") == k).select("q", F.col("score").alias("higher"))
    reach = reach.join(higher, "q", "left").filter(F.col("has") + F.col("rest") >= F.coalesce("higher", F.lit(0.0)) - SLACK)
    best = _best(products(reach, asked, postings), k)
    reads = weighed.groupBy("q").agg(F.sum(F.when(~F.col("unread"), F.col("n")).otherwise(0)).alias("read"), F.sum("n").alias("postings"))
    tried = probed.groupBy("q").agg(F.sum("n").alias("tried"))
    reads = reads.join(tried, "q", "left").select("q", (F.col("read") + F.coalesce("tried", F.lit(0))).alias("read"), "postings")
    return best.join(reads, "q").select("q", "id", "score", "rank", "read", "postings")
