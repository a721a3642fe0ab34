"""Store reports: locations, revenue vs orders, repeat customers, hours and weekdays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import DISPLAY_TZ, local_hour, weekday, weekday_name
from storelens.functions.text import short_money
from storelens.operators.densify import densify
from storelens.operators.distinct import distinct_counts
from storelens.plans.common import known_stores, order_value, store_filter, with_item_sums, with_store
from storelens.plans.sales import RANK_YEARS
from storelens.sources.tables import ShopTables


def store_locations(t: ShopTables) -> DataFrame:
    """Q3: mean store coordinates per city."""
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    return (t.stores.groupBy("city")
            .agg(F.try_divide(F.sum(lat), F.count(lat).cast("double")).alias("avg_latitude"),
                 F.try_divide(F.sum(lon), F.count(lon).cast("double")).alias("avg_longitude"))
            .orderBy(F.asc_nulls_last("city")))


def store_ids(t: ShopTables) -> DataFrame:
    """Q23: the store keys."""
    return t.stores.select("storeid")


def store_year_revenue(t: ShopTables, mode: str = "reference") -> DataFrame:
    """Q6a: item revenue per store and year over orders of known stores."""
    orders = known_stores(t, t.orders.select("orderid", "storeid", "orderdate", "nitems"))
    joined = with_item_sums(t, orders)
    return (joined.groupBy("storeid", F.year("orderdate").alias("year"))
            .agg(F.sum(order_value(mode)).alias("revenue")))


def store_year_order_count(t: ShopTables) -> DataFrame:
    """Q6b: distinct orders per store and year (orders of known stores).

    Where ``orderid`` is the key of orders, counting it equals counting distinct
    order ids — without the extra shuffle of every id a distinct count needs.
    Re-delivered orders (``t.repeated``) are counted by :mod:`storelens.operators.distinct`.
    """
    orders = known_stores(t, t.orders.select("orderid", "storeid", "orderdate"))
    if "orders" in t.repeated:
        keyed = orders.select("storeid", F.year("orderdate").alias("year"), "orderid")
        return distinct_counts(keyed, ["storeid", "year"], "orderid", "order_count")
    return (orders.groupBy("storeid", F.year("orderdate").alias("year"))
            .agg(F.count("orderid").alias("order_count")))


def store_scatter(t: ShopTables, mode: str = "reference") -> DataFrame:
    """Q6: store-years with item revenue and order count (0 when missing), plus a short label.

    Q6a and Q6b in one pass: orders of known stores left-joined 1:1 to their
    item sums give both the revenue (orders with items) and the count of all
    orders; store-years without any order with items are dropped, as in Q6a.
    """
    orders = known_stores(t, t.orders.select("orderid", "storeid", "orderdate", "nitems"))
    joined = with_item_sums(t, orders, "left")
    out = (joined.groupBy("storeid", F.year("orderdate").alias("year"))
           .agg(F.sum(order_value(mode)).alias("revenue"), F.count("orderid").alias("order_count"),
                F.count("item_rows").alias("_with_items"))
           .where(F.col("_with_items") > 0))
    if "orders" in t.repeated:
        out = out.drop("order_count").join(store_year_order_count(t), ["storeid", "year"])
    return out.select("storeid", "year", "revenue", F.col("order_count").cast("long").alias("order_count"),
                      short_money(F.bround(F.col("revenue"), 1)).alias("revenue_label")) \
        .orderBy("storeid", "year")


def store_trend(t: ShopTables, mode: str = "reference") -> DataFrame:
    """Q7: least-squares line of revenue (rounded to 0.1) on order count over all store-years."""
    s = store_scatter(t, mode)
    y = F.bround(F.col("revenue"), 1).cast("double")
    x = F.col("order_count").cast("double")
    return s.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def repeat_customers(t: ShopTables, store=None) -> DataFrame:
    """Q22: per store and year, customers with more than one order at that store in that year."""
    orders = store_filter(t.orders, store)
    per_cust = (orders.groupBy("storeid", "customerid", F.year("orderdate").alias("year"))
                .agg(F.count("orderid").alias("n_orders"))
                .where(F.col("n_orders") > 1))
    # (store, customer, year) is unique here, so a plain count of non-null
    # customers equals the distinct count.
    per_year = per_cust.groupBy("storeid", "year").agg(F.count("customerid").alias("repeat_customers"))
    out = with_store(t, per_year, cols=("city",))
    return out.select("storeid", "city", "year", "repeat_customers").orderBy("year", "storeid")


def orders_per_hour(t: ShopTables, years: Sequence[int] = RANK_YEARS, tz: str = DISPLAY_TZ) -> DataFrame:
    """Q25: orders per store, year and hour of day in ``tz``.

    The year is that of the stored UTC time, the hour that of local time.
    """
    o = t.orders_in(years)
    return (o.groupBy("storeid", F.year("orderdate").alias("order_year"),
                      local_hour("orderdate", tz).alias("order_hour"))
            .agg(F.count(F.lit(1)).alias("total_orders_per_hour"))
            .orderBy(F.asc_nulls_last("storeid"), "order_year", "order_hour"))


def orders_per_hour_band(t: ShopTables, years: Sequence[int] = RANK_YEARS, store=None,
                         width: int = 4, tz: str = DISPLAY_TZ) -> DataFrame:
    """Q26: orders per store, year and ``width``-hour band; every band of a
    present store-year appears, empty ones with 0."""
    if 24 % width:
        raise ValueError("width must divide 24")
    o = store_filter(t.orders_in(years), store)
    band = (F.floor(local_hour("orderdate", tz) / width) * width).cast("int")
    per_band = o.groupBy("storeid", F.year("orderdate").alias("order_year"), band.alias("band")) \
        .agg(F.count(F.lit(1)).alias("total_orders"))
    filled = densify(per_band, ["storeid", "order_year"], "band",
                     F.sequence(F.lit(0), F.lit(24 - width), F.lit(width)), {"total_orders": F.lit(0).cast("long")})
    label = F.concat(F.lpad(F.col("band").cast("string"), 2, "0"), F.lit("-"),
                     F.lpad((F.col("band") + width).cast("string"), 2, "0"))
    return filled.select("storeid", "order_year", label.alias("hour_group"), "total_orders") \
        .orderBy(F.asc_nulls_last("storeid"), "order_year", "hour_group")


def revenue_per_weekday(t: ShopTables, years: Sequence[int] = RANK_YEARS) -> DataFrame:
    """Q27: revenue per store, weekday (0 = Monday) and year."""
    o = t.orders_in(years)
    return (o.groupBy("storeid", weekday("orderdate").alias("order_day_of_week"),
                      F.year("orderdate").alias("order_year"))
            .agg(F.sum("total").alias("total_revenue"))
            .orderBy(F.asc_nulls_last("storeid"), "order_year", "order_day_of_week"))


def weekday_named(t: ShopTables, year: int = 2022, store=None) -> DataFrame:
    """Q28: weekday revenue of one year (and store), with day names, Monday first."""
    w = revenue_per_weekday(store_filter_tables(t, store), [year])
    return w.withColumn("day_name", weekday_name("order_day_of_week")) \
        .orderBy(F.asc_nulls_last("storeid"), "order_day_of_week")


def store_filter_tables(t: ShopTables, store) -> ShopTables:
    """The bundle with orders of one store (or unchanged for None)."""
    return t if store is None else t.with_orders(store_filter(t.orders, store))
