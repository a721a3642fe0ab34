"""Top-k per group and exact in-group ranks that never put a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.session import ensure_checkpoint_dir

# monotonically_increasing_id() keeps the partition index above this bit.
_PARTITION_SHIFT = 33


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each ``by`` group under ``order``; ties are cut.

    ``order`` should end in a unique key so the cut is reproducible. Spark
    plans ``row_number() <= k`` as a ``WindowGroupLimit`` that keeps at most
    ``k`` rows per group on the map side, so a hot group shuffles k rows.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def range_tagged(df: DataFrame, order: Sequence[Column], part: str = "_part") -> DataFrame:
    """``df`` range-partitioned by ``order`` and checkpointed, with the partition's
    number in ``part``: numbers ascend with the order, and a group of any size
    spreads over many partitions. Made once, it serves every
    :func:`class_rank` whose ties ``order`` breaks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint(eager=True)


def class_rank(df: DataFrame, by: Sequence[str], value: str, tie: str, part: str = "_part",
               rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Add each row's 1-based position in its ``by`` group, ordered by (value, tie), and the group size.

    For a ``value`` of few distinct values and rows tagged by
    :func:`range_tagged` in the order of (by, tie). The rows of a group before
    a (value, partition) come from a small table of counts; only the rows of
    one group, value and partition are sorted together. Keys must not be null.
    """
    keys = [*by, value, part]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(value, part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(*by)).alias(size))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(tie))
    return df.join(counts, keys).withColumn(rank, F.col("_before") + inside).drop("_before")


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], *, rank: str = "rank",
               size: str = "group_size") -> DataFrame:
    """Add the 1-based position of each row in its ``by`` group, and the group size.

    ``order`` must be a total order inside a group (end it with a unique
    key); group keys must be non-null. Instead of one task per group, the
    frame is range-sorted by (group, order) — a group of any size spreads
    over many partitions — and each row gets its position in the sorted
    partition from ``monotonically_increasing_id``. The sorted, tagged frame
    is checkpointed so both uses below read the same partitions (and the
    lineage is cut). A small (group, partition) span table then gives every
    partition's offset inside each group.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(c) for c in by]
    tagged = (df.sort(*keys, *order)
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint(eager=True)
              .withColumn("_part", F.shiftright(F.col("_pos"), _PARTITION_SHIFT)))
    spans = tagged.groupBy(*by, "_part").agg(F.min("_pos").alias("_first"),
                                             F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    spans = spans.select(*by, "_part", "_first",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(whole).alias(size))
    ranked = tagged.join(spans, [*by, "_part"])
    return (ranked.withColumn(rank, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
            .drop("_pos", "_part", "_first", "_before"))
