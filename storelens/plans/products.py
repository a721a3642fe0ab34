"""Product reports: category counts, revenue and shares, sizes, repeat-purchase box plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.text import short_money
from storelens.operators.joins import join_dim, semi_join, split_join
from storelens.operators.quantiles import boxplot_stats
from storelens.plans.common import check_mode
from storelens.plans.sales import RANK_YEARS
from storelens.sources.tables import ShopTables

# Fixed value: the product-name pattern of the category report.
NAME_PATTERN = "%Pizza%"


def category_orders(t: ShopTables, years: Sequence[int] = RANK_YEARS,
                    pattern: str = NAME_PATTERN) -> DataFrame:
    """Q19: items of products whose name matches ``pattern`` (SQL LIKE, case-sensitive),
    per category and year → category, order_year, total_orders."""
    prods = t.products.where(F.col("name").like(pattern)).select("sku", "category")
    items = join_dim(t.orderitems, prods, "sku", small=t.is_small("products"))
    orders = t.orders_in(years).select("orderid", F.year("orderdate").alias("order_year"))
    return (split_join(items, orders, "orderid", t.hot_orders)
            .groupBy("category", "order_year").agg(F.count(F.lit(1)).alias("total_orders"))
            .orderBy("order_year", F.desc_nulls_first("total_orders"), "category"))


def revenue_by_product(t: ShopTables, years: Sequence[int] = RANK_YEARS) -> DataFrame:
    """Q20: Σ price over items per product name and year → name, order_year, total_revenue.

    Items are counted per (sku, year) before the product table is joined, so
    the product join sees one row per sku and year.
    """
    orders = t.orders_in(years).select("orderid", F.year("orderdate").alias("order_year"))
    per_sku = split_join(t.orderitems, orders, "orderid", t.hot_orders).groupBy("sku", "order_year").agg(F.count(F.lit(1)).alias("n"))
    priced = join_dim(per_sku, t.products.select("sku", "name", "price"), "sku", small=t.is_small("products"))
    return (priced.groupBy("name", "order_year").agg(F.sum(F.col("n") * F.col("price")).alias("total_revenue"))
            .orderBy("order_year", F.desc_nulls_first("total_revenue"), "name"))


def revenue_share_by_product(t: ShopTables, years: Sequence[int] = RANK_YEARS) -> DataFrame:
    """Q21: Q20 with each product's share of its year's revenue (null in a year whose total is 0).

    Year totals are an aggregate joined back by broadcast (at most
    ``len(years)`` rows), so no task ever holds all products of a year.
    """
    r = revenue_by_product(t, years)
    totals = r.groupBy("order_year").agg(F.sum("total_revenue").alias("_year_total"))
    share = F.try_divide(F.col("total_revenue").cast("double"), F.col("_year_total").cast("double"))
    return (r.join(F.broadcast(totals), "order_year")
            .select("name", "order_year", "total_revenue", share.alias("share"))
            .orderBy("order_year", F.desc_nulls_first("total_revenue"), "name"))


def product_size_sales(t: ShopTables, mode: str = "reference") -> DataFrame:
    """Q24: per product name and size, units sold and revenue over items.

    ``mode='reference'`` counts the order's ``nitems`` for every item row;
    ``'item'`` counts one unit per item row.
    """
    check_mode(mode)
    per_sku = (split_join(t.orderitems, t.orders.select("orderid", "nitems"), "orderid", t.hot_orders)
               .groupBy("sku").agg(F.sum("nitems").alias("units_ref"), F.count(F.lit(1)).alias("units_item")))
    units = F.col("units_ref") if mode == "reference" else F.col("units_item")
    priced = join_dim(per_sku, t.products.select("sku", "name", "size", "price"), "sku",
                      small=t.is_small("products"))
    out = priced.groupBy("name", "size").agg(F.sum(units).alias("total_sold"),
                                             F.sum(units * F.col("price")).alias("total_revenue"))
    return out.withColumn("revenue_label", short_money("total_revenue")).orderBy("name", "size")


def customer_product_counts(t: ShopTables, min_count: int = 2) -> DataFrame:
    """Items per (customer, product name) for known customers, kept when >= ``min_count``."""
    # one narrow row per order meets the customers, not one per item
    orders = semi_join(t.orders.select("orderid", "customerid"), t.customers, "customerid", small=t.is_small("customers"))
    per_sku = split_join(t.orderitems, orders, "orderid", t.hot_orders).groupBy("customerid", "sku").agg(F.count(F.lit(1)).alias("n"))
    named = join_dim(per_sku, t.products.select("sku", "name"), "sku", small=t.is_small("products"))
    return (named.groupBy("customerid", "name").agg(F.sum("n").alias("order_count"))
            .where(F.col("order_count") >= min_count))


def product_boxplot(t: ShopTables, min_count: int = 2) -> DataFrame:
    """Q29: box-plot figures of items per customer and product name, over
    customers with at least ``min_count`` items of it."""
    counts = customer_product_counts(t, min_count)
    return boxplot_stats(counts, ["name"], "order_count").orderBy("name")
