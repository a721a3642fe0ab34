"""Building blocks shared by several reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators.joins import is_hot, join_dim
from storelens.sources.tables import ShopTables

# How an order's items are valued in the item-revenue reports:
#   "reference": every item row counts the order's ``nitems`` units, i.e. an
#                order of n items is counted n times (the dashboard's rule);
#   "item":      every item row is one unit.
MODES = ("reference", "item")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def known_stores(t: ShopTables, df: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``storeid`` is in the stores table (a semi join)."""
    return join_dim(df, t.stores.select("storeid"), "storeid", "left_semi", small=t.is_small("stores"))


def with_store(t: ShopTables, df: DataFrame, cols=("city", "latitude", "longitude")) -> DataFrame:
    """Attach store attributes to an aggregate keyed by ``storeid`` (inner join)."""
    return join_dim(df, t.stores.select("storeid", *cols), "storeid", small=t.is_small("stores"))


def with_item_sums(t: ShopTables, orders: DataFrame, how: str = "inner") -> DataFrame:
    """Orders joined 1:1 to their :func:`order_item_sums`.

    The items of hot orders (``t.hot_orders``) are added up apart, by all tasks that
    read them, and their sums - a row per hot order - are broadcast to these orders.
    """
    if not t.hot_orders:
        return orders.join(order_item_sums(t), "orderid", how)
    hot = is_hot("orderid", t.hot_orders)
    cold = orders.where(~hot).join(order_item_sums(t, ~hot), "orderid", how)
    return cold.unionByName(orders.where(hot).join(F.broadcast(order_item_sums(t, hot)), "orderid", how))


def order_item_sums(t: ShopTables, only: Column | None = None) -> DataFrame:
    """Per order with at least one item of a known product: item rows and Σ price.

    Items of unknown products drop out (inner join). The aggregate leaves the
    frame hash-partitioned by ``orderid``, which the following join to orders
    reuses. ``only``: a condition on the items.
    """
    items = join_dim(t.orderitems if only is None else t.orderitems.where(only), t.products.select("sku", "price"), "sku", small=t.is_small("products"))
    return items.groupBy("orderid").agg(F.count(F.lit(1)).alias("item_rows"),
                                        F.sum("price").alias("price_sum"))


def order_value(mode: str) -> Column:
    """Value of one order over its items, from ``nitems`` and :func:`order_item_sums`.

    Σ over item rows of ``nitems × price`` is ``nitems × Σ price``.
    """
    check_mode(mode)
    if mode == "reference":
        return F.col("nitems") * F.col("price_sum")
    return F.col("price_sum")


def store_filter(df: DataFrame, store) -> DataFrame:
    """Rows of one store, or all rows when ``store`` is None."""
    return df if store is None else df.where(F.col("storeid") == F.lit(store))
