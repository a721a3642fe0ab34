"""Places of rows in an order, for groups of any size (keys may be null)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed


def positions(df: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """``df`` with ``pos``, the 0-based place in the order (inside ``group``, the first of it), and ``size``, how many there are.

    One range sort, checkpointed; offsets come from one count per group and
    partition. Equal rows are told apart by their number, so a repeated row
    spreads over partitions.
    """
    base = checkpointed(df.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    tagged = checkpointed(base.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
                          .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    tagged = tagged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_g", F.struct(group) if group else F.lit(0))
    spans = tagged.groupBy("_g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per (group, partition)
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("_g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy("_g")).alias("size"))
    return (tagged.alias("t").join(offsets.alias("o"), F.col("t._g").eqNullSafe(F.col("o._g"))
                                   & (F.col("t._part") == F.col("o._part")))
            .select(*[F.col(f"t.`{c}`") for c in df.columns],
                    (F.col("t._at") - F.col("o._first") + F.col("o._before")).alias("pos"), "size"))
