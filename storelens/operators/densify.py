"""Zero-fill: one row for every key of a per-group domain, gaps filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.session import ensure_checkpoint_dir

GAP = 4096  #: rows that one exploded array of a gap holds at most


def densify(df: DataFrame, by: Sequence[str], key: str, domain: Column,
            fill: dict[str, object]) -> DataFrame:
    """Rows for every ``key`` in ``domain`` of each ``by`` group present in ``df``.

    ``domain`` is an array Column evaluated as an aggregate over the group,
    e.g. ``F.sequence(F.min(k), F.max(k), F.expr("INTERVAL 1 MONTH"))`` for
    the interior of a range, or a constant ``F.sequence(...)`` for a fixed
    list of categories. Groups absent from ``df`` produce no rows. Columns of
    ``fill`` are coalesced to their value; other columns stay null in the gaps.

    ``df`` has one row per group and key, and few keys per group (those of the
    domain): each group becomes a map from key to values that the exploded
    domain looks up, so ``df`` is read once and not joined with itself.
    """
    values = [c for c in df.columns if c not in (*by, key)]
    entry = F.struct(F.col(key).alias("key"), F.struct(*values).alias("value"))
    grouped = df.where(F.col(key).isNotNull()).groupBy(*by).agg(
        domain.alias("_domain"), F.map_from_entries(F.collect_list(entry)).alias("_values"))
    out = grouped.select(*by, F.explode("_domain").alias(key), "_values").withColumn(
        "_v", F.try_element_at("_values", F.col(key)))
    return out.select(*by, key, *[F.coalesce(F.col(f"_v.{c}"), F.lit(fill[c])).alias(c) if c in fill
                                  else F.col(f"_v.{c}").alias(c) for c in values])


def fill_gaps(df: DataFrame, by: Sequence[str], key: str, fill: dict[str, object], step: int = 1) -> DataFrame:
    """Rows for every ``step`` between the keys of each group, for domains and groups of any size.

    ``df`` has one row per group and key (whole numbers, or dates: ``step`` days);
    rows with a null key are left out. Instead of a map per group, the rows are
    range-sorted by (group, key), so a group of any size spreads over partitions;
    each row looks at its neighbour and makes the rows of the gap after it, ``GAP`` at
    a time. What the last row of a partition needs to know, the group's next key,
    comes from a small table of one row per group and partition. Columns of
    ``fill`` get their value in the gaps, other columns null. Groups keep their first
    and last key; null groups are groups.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kind, date = df.schema[key].dataType, df.schema[key].dataType.typeName() == "date"
    at = F.unix_date(key) if date else F.col(key)
    values = [c for c in df.columns if c not in (*by, key)]
    order = [F.col(c).asc_nulls_first() for c in by] + [F.col("_k")]
    group = F.struct(*by) if by else F.lit(0)
    tagged = (df.where(F.col(key).isNotNull()).select("*", at.cast("long").alias("_k"), group.alias("_g"))
              .repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    firsts = tagged.groupBy("_g", "_part").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    border = firsts.select("_g", "_part", "_last", F.lead("_first").over(Window.partitionBy("_g").orderBy("_part")).alias("_border"))
    inside = tagged.withColumn("_next", F.lead("_k").over(Window.partitionBy("_part", "_g").orderBy("_k")))
    # the border belongs to the last row of a group in its partition only
    ends = border.where("_border is not null").select(F.col("_g").alias("_bg"), F.col("_part").alias("_bp"), F.col("_last").alias("_bk"), "_border")
    met = inside.join(ends, F.col("_g").eqNullSafe(F.col("_bg")) & (F.col("_part") == F.col("_bp")) & (F.col("_k") == F.col("_bk")), "left")
    after = met.withColumn("_to", F.coalesce("_next", "_border"))
    back = (lambda c: F.date_from_unix_date(c.cast("int"))) if date else (lambda c: c.cast(kind))
    gaps = (after.where(F.col("_to") - F.col("_k") > step)
            .select(*by, "_to", F.explode(F.sequence(F.col("_k") + step, F.col("_to") - 1, F.lit(step * GAP).cast("long"))).alias("_from"))
            .select(*by, F.explode(F.sequence("_from", F.least(F.col("_from") + step * (GAP - 1), F.col("_to") - 1), F.lit(step).cast("long")))
                    .alias("_k")))
    filled = gaps.select(*by, back(F.col("_k")).alias(key),
                         *[F.lit(fill.get(c)).cast(df.schema[c].dataType).alias(c) for c in values])
    kept = tagged.select(*by, key, *[F.coalesce(F.col(c), F.lit(fill[c])).cast(df.schema[c].dataType).alias(c) if c in fill else F.col(c)
                                     for c in values])
    return kept.unionByName(filled)


def pct_change(base: Column, new: Column) -> Column:
    """(new - base) / base * 100; null when the base is null or zero."""
    return F.try_divide(new - base, base) * F.lit(100)
