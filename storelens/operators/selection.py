"""Exact order statistics of groups of any size, without sorting all rows and without a value map.

Two ways to the same answer:

* :func:`select_ranks` - radix selection for whole numbers and decimals. The values
  become whole offsets from their minimum, read in digits of ``BITS`` bits from the
  top: each pass counts the digits among the rows that still share a wanted rank's
  leading digits and so finds its next digit. A pass shuffles at most 2^BITS
  counts per wanted rank, whatever the number of rows or distinct values.
* :func:`bracketed_quantiles` - for any numeric column. A mergeable quantile sketch
  gives each wanted quantile a narrow bracket that is sure to hold it; a second
  pass counts the rows between the brackets and keeps the values inside (a few
  per mille of the rows), and running sums of these counts give the exact ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.session import ensure_checkpoint_dir

BITS = 16           #: bits of a radix digit
ACCURACY = 10_000   #: the sketch's rank error is at most 1 / ACCURACY of a group's rows


def _match(by: Sequence[str], a: str, b: str) -> Column:
    """Null-safe equality of the group columns of two aliases (no columns: true)."""
    return reduce(Column.__and__, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in by], F.lit(True))


def _scale(kind: T.DataType) -> int:
    if isinstance(kind, T.DecimalType):
        return kind.scale
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return 0
    raise ValueError(f"radix selection needs whole numbers or decimals, not {kind.simpleString()}")


def select_ranks(df: DataFrame, by: Sequence[str], x: str, ranks: dict[str, Column], size: str = "size") -> DataFrame:
    """One row per group: for each output name the value of ``x`` at its 1-based rank.

    ``ranks`` maps names to rank expressions over the column ``size``, the group's
    number of non-null values. Null values are ignored; a group without any is
    absent. The values' bounds are read first (one row), which sets the number of
    passes: ceil(bits of the range / BITS). A range beyond 62 bits is an error
    (:func:`bracketed_quantiles` has no such limit).
    """
    kind = df.schema[x].dataType
    scale = _scale(kind)
    whole = F.col(x) if scale == 0 else F.col(x) * F.lit(10 ** scale)
    ensure_checkpoint_dir(df.sparkSession)
    rows = (df.where(F.col(x).isNotNull()).select(*by, whole.cast("decimal(38,0)").alias("_v"))
            .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True))
    low, high = rows.agg(F.min("_v"), F.max("_v")).first()
    low, high = int(low or 0), int(high or 0)
    if high - low >= 1 << 62:
        raise ValueError(f"{x} spans more than 62 bits; use bracketed_quantiles")
    digits = max(1, -(-(high - low).bit_length() // BITS))
    rows = rows.select(*by, (F.col("_v") - F.lit(low).cast("decimal(38,0)")).cast("long").alias("_u"), "_n")
    names = list(ranks)
    sizes = rows.groupBy(*by).agg(F.sum("_n").alias(size))
    # targets: the rank still wanted among the rows that share the digits found so far
    targets = (sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("_t"), ranks[n].cast("long").alias("_r"))
                                                     for k, n in enumerate(names)])).alias("_x"))
               .select(*by, "_x._t", "_x._r", F.lit(0).cast("long").alias("_p")))
    for k in range(digits - 1, -1, -1):
        prefix, digit = F.shiftright("_u", (k + 1) * BITS), F.shiftright("_u", k * BITS).bitwiseAND((1 << BITS) - 1)
        # distinct prefixes only: several ranks of a group may share one
        wanted = targets.select(*by, "_p").distinct()
        counts = (rows.select(*by, prefix.alias("_p"), digit.alias("_d"), "_n").alias("r")
                  .join(wanted.alias("w"), _match([*by, "_p"], "r", "w"), "left_semi")
                  .groupBy(*by, "_p", "_d").agg(F.sum("_n").alias("_c")))
        upto = Window.partitionBy(*by, "_p").orderBy("_d")  # 2^BITS rows at most
        counts = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_before", F.col("_upto") - F.col("_c"))
        hit = (_match([*by, "_p"], "t", "c") & (F.col("c._before") < F.col("t._r")) & (F.col("t._r") <= F.col("c._upto")))
        targets = (targets.alias("t").join(counts.alias("c"), hit)
                   .select(*[F.col(f"t.`{c}`") for c in [*by, "_t"]], (F.col("t._r") - F.col("c._before")).alias("_r"),
                           (F.shiftleft("t._p", BITS) + F.col("c._d")).alias("_p")))
    value = (F.col("_p").cast("decimal(38,0)") + F.lit(low).cast("decimal(38,0)"))
    back = (value.cast(kind) if scale == 0 else
            (value.cast(f"decimal(38,{scale})") / F.lit(10 ** scale)).cast(kind))
    return targets.groupBy(*by).agg(*[F.max(F.when(F.col("_t") == k, back)).alias(n) for k, n in enumerate(names)])


def bracketed_quantiles(df: DataFrame, by: Sequence[str], x: str, fractions: Sequence[float],
                        accuracy: int = ACCURACY, out: str = "_q") -> DataFrame:
    """One row per group with the array ``out`` of exact quantiles (linear interpolation, as DOUBLE).

    The quantile of fraction q lies between the values at 0-based places floor(h)
    and floor(h) + 1 with h = (N - 1) q. The sketch's values at fractions a little
    below and above q enclose both places. Rows outside every bracket only count;
    rows inside are counted per value, so a value that very many rows share is one
    row. No task holds more than the values inside a group's brackets, about
    8 N / accuracy a fraction. Null values are ignored; a group without any is
    absent. Group keys may be null.
    """
    if not by:
        return bracketed_quantiles(df.select(F.lit(0).alias("_all"), x), ["_all"], x, fractions, accuracy, out).drop("_all")
    v = F.col(x).cast("double")
    n = len(fractions)
    slack = 4.0 / accuracy  # four times the sketch's error
    probes = [p for q in fractions for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    vals = df.where(F.col(x).isNotNull()).select(*by, v.alias("_x"))
    sketch = vals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_N"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
        F.percentile_approx("_x", probes, accuracy).alias("_b"))
    # a probe at the very end, or with too few rows for the slack to matter, opens to the group's bounds
    few = F.col("_N") * F.lit(slack) < 4
    low = [F.when(few | F.lit(probes[2 * k] <= 0), F.col("_lo")).otherwise(F.col("_b")[2 * k]) for k in range(n)]
    high = [F.when(few | F.lit(probes[2 * k + 1] >= 1), F.col("_hi")).otherwise(F.col("_b")[2 * k + 1]) for k in range(n)]
    brackets = sketch.select(*by, "_N", F.array(*low).alias("_low"), F.array(*high).alias("_high"))
    joined = vals.alias("v").join(brackets.alias("b"), _match(by, "v", "b"))
    inside = reduce(Column.__or__, [(F.col("_x") >= F.col("_low")[k]) & (F.col("_x") <= F.col("_high")[k]) for k in range(n)])
    # the gap a row outside lies in: how many brackets are entirely below it
    gap = reduce(Column.__add__, [(F.col("_x") > F.col("_high")[k]).cast("int") for k in range(n)])
    counts = (joined.select(*[F.col(f"v.`{c}`") for c in by], "_N", F.when(inside, F.col("_x")).alias("_in"),
                            F.when(~inside, gap).alias("_gap"), "_x")
              .groupBy(*by, "_N", "_in", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_at")))
    upto = Window.partitionBy(*by).orderBy("_at")
    ranked = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_before", F.col("_upto") - F.col("_c"))
    picks = []
    for k, q in enumerate(fractions):
        h = (F.col("_N") - 1) * F.lit(float(q))
        place = F.floor(h)
        for name, at in ((f"_a{k}", place), (f"_b{k}", F.least(place + 1, F.col("_N") - 1))):
            here = (F.col("_before") <= at) & (at < F.col("_upto"))
            picks.append(F.max(F.when(here, F.coalesce("_in", F.raise_error(F.lit("quantile outside its bracket")).cast("double"))))
                         .alias(name))
    found = ranked.groupBy(*by, "_N").agg(*picks)

    def between(k: int, q: float) -> Column:
        h = (F.col("_N") - 1) * F.lit(float(q))
        t = h - F.floor(h)
        a, b = F.col(f"_a{k}"), F.col(f"_b{k}")
        return F.when(t == 0, a).otherwise(a + (b - a) * t)
    return found.select(*by, F.array(*[between(k, q) for k, q in enumerate(fractions)]).alias(out))
