"""Exact distinct counts by mergeable state.

A state is a table that can be kept, and merged with the states of other rows (a
later delivery, another half of the table): the merged state equals the state of all
rows together, so a count never starts again from the raw rows and a row delivered
twice counts once.

* ``bitmap`` - whole-number keys: one bitmap of 32,768 bits per group and range of
  ids (``bitmap_construct_agg``, merged by ``bitmap_or_agg``). Partial bitmaps are
  built before the shuffle, so a hot group sends its bitmaps, not its rows.
* ``set`` - any key: the distinct (group, key) rows, hash-partitioned by both, so no
  group is held in one task.

Bitmaps pay where a group uses many ids of a range; scattered ids would fill a 4 KB
bitmap each. ``form=None`` measures that (one approximate aggregate); both forms
give the same counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ids per group and range from which a bitmap is smaller than the ids themselves
DENSE = 256
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _whole(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, _INTEGRAL)


def state_form(df: DataFrame, by: Sequence[str], key: str) -> str:
    """``"bitmap"`` or ``"set"``, whichever state of the rows is smaller."""
    if not _whole(df, key):
        return "set"
    ids, ranges = df.where(F.col(key).isNotNull()).agg(
        F.approx_count_distinct(F.struct(*by, key)),
        F.approx_count_distinct(F.struct(*by, F.bitmap_bucket_number(F.col(key).cast("long"))))).first()
    return "bitmap" if ids >= DENSE * max(ranges, 1) else "set"


def distinct_state(df: DataFrame, by: Sequence[str], key: str, form: str | None = None) -> DataFrame:
    """The distinct ``key`` values of each group as a mergeable table.

    Columns: ``by`` with ``_range`` and ``_bits`` (bitmap) or with ``_key`` (set).
    A group whose keys are all null keeps an empty state, and so a count of 0.
    """
    form = form or state_form(df, by, key)
    if form == "set":
        return df.select(*by, F.col(key).alias("_key")).distinct()
    if form != "bitmap":
        raise ValueError(f"form must be 'bitmap' or 'set', not {form!r}")
    if not _whole(df, key):
        raise ValueError(f"a bitmap needs a whole-number key, not {df.schema[key].dataType.simpleString()}")
    k = F.col(key).cast("long")
    return (df.select(*by, F.bitmap_bucket_number(k).alias("_range"), F.bitmap_bit_position(k).alias("_bit"))
            .groupBy(*by, "_range").agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def merge_distinct(*states: DataFrame) -> DataFrame:
    """One state for the rows of all ``states`` (of one form, with the same groups)."""
    whole = reduce(DataFrame.unionByName, states)
    if "_bits" not in whole.columns:
        return whole.distinct()
    keys = [c for c in whole.columns if c != "_bits"]
    return whole.groupBy(*keys).agg(F.bitmap_or_agg("_bits").alias("_bits"))


def state_counts(state: DataFrame, by: Sequence[str], out: str = "count") -> DataFrame:
    """Number of distinct keys per group of a (merged) state."""
    if "_bits" in state.columns:
        count = F.sum(F.when(F.col("_range").isNotNull(), F.bitmap_count("_bits")).otherwise(0))
    else:
        count = F.count("_key")
    return state.groupBy(*by).agg(F.coalesce(count, F.lit(0)).cast("long").alias(out))


def distinct_counts(df: DataFrame, by: Sequence[str], key: str, out: str = "count",
                    form: str | None = None) -> DataFrame:
    """``COUNT(DISTINCT key)`` per group."""
    return state_counts(distinct_state(df, by, key, form), by, out)
