"""Connected components of a large edge list as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) pairs -> (node, root): the smallest node reachable, for every node of a pair.

    Alternating large-star and small-star steps: each links the neighbours of a
    node with the smallest of them, so paths shrink quickly (a number of rounds
    logarithmic in practice). A round moves at most a few rows per edge; sums
    are combined before the shuffle, and the join with one row per node leaves a
    hub's edges to be split at run time. Ends when a round changes nothing.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _digest(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(e.join(least, "u")
                         .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                   F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
                         .select("p.u", "p.v").where("u <> v").distinct())
        new = _digest(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
