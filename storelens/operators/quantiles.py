"""Quantile statistics per group: bins, lower median, box-plot figures.

Quantiles are exact with linear interpolation between order statistics (the
rule of ``numpy.quantile`` / ``pandas.qcut``). Two ways to get them:

* ``method="count"`` — Spark's ``percentile`` aggregate. Its buffer is a
  value→count map per group, so memory grows with the number of *distinct*
  values in a group: right for small domains (day counts, item counts).
* ``method="sort"`` — order statistics from :func:`group_rank`: every group
  spreads over many partitions of a range sort.
* ``method="bracket"`` — :func:`storelens.operators.selection.bracketed_quantiles`:
  a sketch brackets each quantile and one more pass finds it; right for
  continuous values (money), without a sort of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators.ranking import group_rank
from storelens.operators.selection import bracketed_quantiles, select_ranks


def _fractions(n: int) -> list[float]:
    return [k / n for k in range(n + 1)]


def quantile_edges(df: DataFrame, by: Sequence[str], x: str, n: int = 4, *,
                   method: str = "count", tie: Sequence[str] = (), prefix: str = "_e") -> DataFrame:
    """One row per group with ``n + 1`` edges ``{prefix}0 … {prefix}n``.

    Edge k is the k/n quantile of ``x`` in the group (edge 0 the minimum,
    edge n the maximum); null ``x`` values are ignored. ``tie``: columns that
    make (x, tie) unique in a group, so the rank sort can split a value
    shared by very many rows; without it a hash of the row is used.
    """
    vals = df.where(F.col(x).isNotNull())
    if method == "count":
        q = vals.groupBy(*by).agg(F.percentile(F.col(x).cast("double"), _fractions(n)).alias("_q"))
        return q.select(*by, *[F.col("_q")[k].alias(f"{prefix}{k}") for k in range(n + 1)])
    if method == "bracket":
        q = bracketed_quantiles(vals, by, x, _fractions(n))
        return q.select(*by, *[F.col("_q")[k].alias(f"{prefix}{k}") for k in range(n + 1)])
    if method != "sort":
        raise ValueError(f"method must be 'count', 'sort' or 'bracket', not {method!r}")
    tie_cols = [F.col(c) for c in tie] or [F.xxhash64(*[F.col(f"`{c}`") for c in vals.columns])]
    ranked = group_rank(vals, by, [F.col(x), *tie_cols], rank="_r", size="_N")
    return edges_from_ranks(ranked, by, x, "_r", "_N", n, prefix)


def _edge_parts(x: str, rank: str, size: str, n: int):
    """Per edge k: (row at floor(h), row at floor(h)+1, fraction) with h = (N-1)k/n."""
    pos = F.col(rank) - 1
    for k in range(n + 1):
        h = (F.col(size) - 1) * F.lit(k) / F.lit(n)
        lo = F.floor(h)
        yield k, pos == lo, pos == lo + 1, h - lo


def _interpolate(a: Column, b: Column, t: Column) -> Column:
    return F.when(t == 0, a).otherwise(a + (b - a) * t)


def edges_from_ranks(ranked: DataFrame, by: Sequence[str], x: str, rank: str, size: str, n: int = 4,
                     prefix: str = "_e") -> DataFrame:
    """Quantile edges per group from rows ranked 1…N by ``x`` (see :func:`quantile_edges`).

    Only the rows at positions floor(h) and floor(h)+1 of each edge are kept
    (at most 2(n+1) per group) and aggregated.
    """
    v = F.col(x).cast("double")
    keep, aggs = F.lit(False), []
    for k, at_lo, at_hi, t in _edge_parts(x, rank, size, n):
        keep = keep | at_lo | at_hi
        aggs.append(_interpolate(F.max(F.when(at_lo, v)), F.max(F.when(at_hi, v)), F.max(t)).alias(f"{prefix}{k}"))
    return ranked.where(keep).groupBy(*by).agg(*aggs)


def rank_bin(rank: str, size: str, n: int = 4) -> Column:
    """Bin 1…n of rank r among N: max(1, ceil(n(r-1)/(N-1))), and 1 when N = 1.

    ``ceil(a / b)`` for a >= 0, b > 0 is ``(a + b - 1) div b`` in exact integers.
    """
    ceil_bin = F.expr(f"({int(n)} * (`{rank}` - 1) + `{size}` - 2) div (`{size}` - 1)")
    return F.when(F.col(size) <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), ceil_bin))


def bin_of_edges(x: Column, n: int, prefix: str) -> Column:
    """Bin 1…n of ``x`` against edge columns ``{prefix}1 … {prefix}n-1``:
    the smallest k with x <= edge_k (the group minimum falls in bin 1)."""
    expr = F.when(x.isNull(), F.lit(None))
    for k in range(1, n):
        expr = expr.when(x <= F.col(f"{prefix}{k}"), F.lit(k))
    return expr.otherwise(F.lit(n))


def unique_edges_or_fail(b: Column, n: int, prefix: str, what: str) -> Column:
    """``b``, or a query failure where two edges ``{prefix}k`` of the row's group are equal."""
    dup = F.lit(False)
    for k in range(n):
        dup = dup | (F.col(f"{prefix}{k}") == F.col(f"{prefix}{k + 1}"))
    return F.when(dup, F.raise_error(F.lit(f"quantile edges of {what} are not unique"))).otherwise(b)


def qcut_value(df: DataFrame, by: Sequence[str], x: str, out: str, n: int = 4, *,
               reverse: bool = False, method: str = "count", duplicates: str = "skip",
               tie: Sequence[str] = ()) -> DataFrame:
    """Quantile bin 1…n of ``x`` inside each group, added as column ``out``.

    Bins are closed on the right and the group minimum falls in bin 1.
    ``reverse`` numbers the bins n…1. With repeated edges ``duplicates='skip'``
    applies the rule as is (a bin between equal edges stays empty; a group of
    one value gets bin 1) and ``'raise'`` fails the query.
    """
    if duplicates not in ("skip", "raise"):
        raise ValueError("duplicates must be 'skip' or 'raise'")
    prefix = f"_{out}_e"
    edges = quantile_edges(df, by, x, n, method=method, tie=tie, prefix=prefix)
    joined = df.join(edges, list(by), "left")  # one row per group: broadcast where its measured size allows
    b = bin_of_edges(F.col(x).cast("double"), n, prefix)
    if duplicates == "raise":
        b = unique_edges_or_fail(b, n, prefix, x)
    if reverse:
        b = F.lit(n + 1) - b
    return joined.withColumn(out, b.cast("int")).drop(*[f"{prefix}{k}" for k in range(n + 1)])


def qcut_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, n: int = 4, *,
              reverse: bool = False) -> DataFrame:
    """Quantile bin of each row's rank ``r`` (1…N, ties broken by ``order``).

    Equals ``qcut(rank(method='first'), n)``: bin = max(1, ceil(n(r-1)/(N-1))),
    and 1 when N = 1. This is not ``ntile``, which fills the first bins first.
    """
    ranked = group_rank(df, by, order, rank="_r", size="_N")
    b = rank_bin("_r", "_N", n)
    if reverse:
        b = F.lit(n + 1) - b
    return ranked.withColumn(out, b.cast("int")).drop("_r", "_N")


def lower_median(df: DataFrame, by: Sequence[str], x: str, out: str = "median", method: str = "disc") -> DataFrame:
    """Element ``(N + 1) div 2`` of the sorted values per group (the lower median).

    ``method="disc"``: Spark's ``percentile_disc``, whose task holds a group's
    distinct values: for groups of bounded size. ``method="radix"``: digit counts
    (:func:`storelens.operators.selection.select_ranks`), for any number of values;
    a whole table without values gives one null row, as the aggregate does.
    """
    if method == "radix":
        found = select_ranks(df, by, x, {out: F.expr("(size + 1) div 2")})
        return found if by else found.agg(F.max(out).alias(out))
    if method != "disc":
        raise ValueError(f"method must be 'disc' or 'radix', not {method!r}")
    med = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}`)")
    return df.groupBy(*by).agg(med.alias(out))


def boxplot_stats(df: DataFrame, by: Sequence[str], x: str, method: str = "count") -> DataFrame:
    """min, lower_whisker, q1, median, q3, upper_whisker, max, iqr per group.

    Whiskers are the bounds q1 - 1.5 iqr and q3 + 1.5 iqr clamped to the data
    range (not the nearest data points). ``method="count"`` uses the value→count
    ``percentile`` buffer, so ``x`` should have few distinct values per group
    (counts); ``"bracket"`` takes any values (groups without a value are absent).
    """
    if method not in ("count", "bracket"):
        raise ValueError(f"method must be 'count' or 'bracket', not {method!r}")
    v = F.col(x).cast("double")
    if method == "count":
        s = df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"),
                                F.percentile(v, [0.25, 0.5, 0.75]).alias("_q"))
    else:
        s = bracketed_quantiles(df, by, x, [0.0, 0.25, 0.5, 0.75, 1.0], out="_e").select(
            *by, F.col("_e")[0].alias("min"), F.col("_e")[4].alias("max"), F.slice("_e", 2, 3).alias("_q"))
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    iqr = q3 - q1
    return s.select(*by, F.col("min"),
                    F.greatest(F.col("min"), q1 - 1.5 * iqr).alias("lower_whisker"),
                    q1.alias("q1"), med.alias("median"), q3.alias("q3"),
                    F.least(F.col("max"), q3 + 1.5 * iqr).alias("upper_whisker"),
                    F.col("max"), iqr.alias("iqr"))
