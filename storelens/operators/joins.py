"""Dimension joins that broadcast only a side of checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fallback budget when the session disables the automatic threshold.
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024

# Bytes per row of a broadcast hash relation beyond the field data: the
# row's null bitset word and a hash-table entry (key + pointer).
_ROW_OVERHEAD = 8 + 16
# Variable-width types whose bytes are measured; every other field takes one
# 8-byte slot of Spark's row format.
_VARIABLE = (T.StringType, T.BinaryType)


def broadcast_budget(df: DataFrame) -> int:
    """Bytes a broadcast side may hold: the session's join threshold."""
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(DEFAULT_BROADCAST_BYTES))
    raw = raw.strip().lower().rstrip("b")
    mult = 1
    for suffix, m in (("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30)):
        if raw.endswith(suffix):
            raw, mult = raw[:-1], m
    value = int(float(raw) * mult)
    return value if value > 0 else DEFAULT_BROADCAST_BYTES


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Prove that ``df`` as a broadcast hash relation stays within ``max_bytes``.

    Size model of Spark's row format: one 8-byte slot per field, the
    variable-width bytes rounded up to 8, plus a null-bitset word and a
    hash-table entry per row. First an exact ``count()`` — for a projection
    of a Parquet table Spark answers it from the file footers without
    reading column data, so a large table is rejected cheaply. Only when the
    rows fit at their fixed size are the actual string/binary bytes summed,
    in one pass over those (few) rows.
    """
    budget = max_bytes or broadcast_budget(df)
    fields = df.schema.fields
    fixed = _ROW_OVERHEAD + 8 * len(fields)
    var_cols = [f.name for f in fields if isinstance(f.dataType, _VARIABLE)]
    n = df.count()
    if n * fixed > budget:
        return False
    if not var_cols:
        return True
    total = F.lit(0)
    for c in var_cols:
        padded = F.ceil(F.octet_length(F.col(f"`{c}`")) / 8) * 8
        total = total + F.coalesce(F.sum(padded), F.lit(0))
    return n * fixed + df.agg(total.alias("b")).first()["b"] <= budget


def join_dim(fact: DataFrame, dim: DataFrame, on: str | Sequence[str] | Column,
             how: str = "inner", small: bool | None = None) -> DataFrame:
    """Join a fact table to a dimension, broadcasting the dimension when proven small.

    ``small`` is the (memoised) result of :func:`fits_broadcast` for the
    dimension's base table; without it the check runs here. A dimension
    beyond the budget is joined by a shuffle join that AQE can still turn
    into a broadcast, or split when skewed.
    """
    if small is None:
        small = fits_broadcast(dim)
    return fact.join(F.broadcast(dim) if small else dim, on, how)


#: Session settings under which Spark adds the Bloom filter of :func:`semi_join` at run time; its own defaults ask
#: for a filtered side of 10 MB at most. ``numBits`` bounds the filter, which is what reaches every task.
BLOOM_SETTINGS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "10g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "400000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 31),
}


def semi_join(fact: DataFrame, dim: DataFrame, key: str, small: bool | None = None) -> DataFrame:
    """Rows of ``fact`` whose ``key`` is in ``dim``; before a shuffle join, rows that cannot be go first.

    A small ``dim`` is broadcast. A large one is shuffled with the fact table, so the
    fact's rows are reduced below the shuffle: by the range of the dimension's
    keys (one aggregate over the key column; as a filter it reaches the scan and skips
    row groups), and by a Bloom filter of them, which Spark builds and pushes below
    the exchange when the session has :data:`BLOOM_SETTINGS`. Both only drop rows that
    the join drops too.
    """
    keys = dim.select(key)
    if small is None:
        small = fits_broadcast(keys)
    if small:
        return fact.join(F.broadcast(keys), key, "left_semi")
    low, high = keys.agg(F.min(key), F.max(key)).first()
    if low is None:
        return fact.join(keys, key, "left_semi")
    within = F.col(key).between(F.lit(low), F.lit(high))
    return fact.where(within).join(keys.where(within), key, "left_semi")


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys that hold at least ``share`` of the rows: 1 / share of them at most, none missed.

    A frequent-items sketch (one pass, no shuffle of rows) names the candidates - it
    tracks ten times as many items as can be heavy, so each of those is among them -
    and an exact count of the candidates settles it.
    """
    most = int(1 / share) + 1
    n, top = df.agg(F.count(key), F.expr(f"approx_top_k(`{key}`, {2 * most}, {20 * most})")).first()
    found = [r.item for r in top or [] if r.item is not None]
    if not n or not found:
        return []
    exact = df.where(F.col(key).isin(found)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r[key] for r in exact.where(F.col("n") >= share * n).collect())


def is_hot(key: str, hot: Sequence) -> Column:
    return F.coalesce(F.col(key).isin(list(hot)), F.lit(False))


def split_join(many: DataFrame, one: DataFrame, key: str, hot: Sequence = (), how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` (unique ``key``), the rows of the ``hot`` keys apart from the rest.

    The cold rows are joined as the tables lie - on tables bucketed by ``key``
    without an exchange - and the hot ones, in as many tasks as their files have
    splits, meet the few rows of ``one`` that they belong to (``len(hot)`` at most, so
    these are broadcast). A key of any size is never one task's work.
    """
    if not hot:
        return many.join(one, key, how)
    cold = many.where(~is_hot(key, hot)).join(one.where(~is_hot(key, hot)), key, how)
    return cold.unionByName(many.where(is_hot(key, hot)).join(F.broadcast(one.where(is_hot(key, hot))), key, how))
