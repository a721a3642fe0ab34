"""Sales reports: best/worst stores, yearly pivot, headline figures, monthly revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.dates import month_key, month_name
from storelens.functions.text import millions_text, money_text, percent_text, short_money
from storelens.operators.densify import densify, fill_gaps, pct_change
from storelens.operators.quantiles import lower_median
from storelens.operators.ranking import top_k
from storelens.plans.common import (known_stores, order_value, store_filter, with_item_sums,
                                    with_store)
from storelens.sources.tables import ShopTables

# The reports' default years.
PIVOT_YEARS = (2018, 2019, 2020, 2021, 2022)
RANK_YEARS = (2020, 2021, 2022)


def yearly_store_sales(t: ShopTables, years: Sequence[int] = RANK_YEARS) -> DataFrame:
    """Σ total per store and year, for orders of ``years``."""
    return (t.orders_in(years)
            .groupBy("storeid", F.year("orderdate").alias("year"))
            .agg(F.sum("total").alias("annual_sales")))


def _ranked_stores(t, years, k, best):
    # PostgreSQL order: nulls first when descending, last when ascending (H12)
    sales = F.desc_nulls_first("annual_sales") if best else F.asc_nulls_last("annual_sales")
    ranked = top_k(yearly_store_sales(t, years), ["year"], [sales, F.asc_nulls_last("storeid")], k)
    return ranked.orderBy("year", sales, F.asc_nulls_last("storeid"))


def top_stores(t: ShopTables, years: Sequence[int] = RANK_YEARS, k: int = 5) -> DataFrame:
    """Q1: the ``k`` stores with the highest sales per year → storeid, year, annual_sales, rank."""
    return _ranked_stores(t, years, k, best=True)


def worst_stores(t: ShopTables, years: Sequence[int] = RANK_YEARS, k: int = 5) -> DataFrame:
    """Q2: the ``k`` stores with the lowest sales per year."""
    return _ranked_stores(t, years, k, best=False)


def store_annual_revenues(t: ShopTables, years: Sequence[int] = PIVOT_YEARS) -> DataFrame:
    """Q5: one row per store with orders; ``revenue_<year>`` per year, 0 without sales.

    Orders are summed per store first (a partial aggregate per task), then
    the few store rows are joined; a store whose orders all fall outside
    ``years`` keeps zeros, a store without orders is absent.
    """
    y = F.year("orderdate")
    sums = [F.sum(F.when(y == F.lit(int(yr)), F.col("total")).otherwise(F.lit(0))).alias(f"revenue_{int(yr)}")
            for yr in years]
    per_store = t.orders.groupBy("storeid").agg(*sums)
    out = with_store(t, per_store)
    return out.select("storeid", "city", "latitude", "longitude", *[f"revenue_{int(yr)}" for yr in years]) \
        .orderBy(F.asc_nulls_last("city"), "storeid")


def kpi_total_revenue(t: ShopTables) -> DataFrame:
    """Q9: Σ total over all orders → total_revenue."""
    return t.orders.agg(F.sum("total").alias("total_revenue"))


def _store_sums(t: ShopTables) -> DataFrame:
    return t.orders.groupBy("storeid").agg(F.sum("total").alias("store_revenue"))


def kpi_avg_revenue_per_store(t: ShopTables) -> DataFrame:
    """Q10: mean over stores (as found in orders) of their total revenue."""
    s = _store_sums(t)
    return s.agg(F.try_divide(F.sum("store_revenue").cast("double"), F.count("store_revenue").cast("double"))
                 .alias("average_revenue_per_store"))


def store_item_revenue(t: ShopTables, year: int, mode: str = "reference") -> DataFrame:
    """Σ item value per store in ``year`` (orders with items of known products)."""
    orders = t.orders_in([year]).select("orderid", "storeid", "nitems")
    joined = with_item_sums(t, orders)
    return joined.groupBy("storeid").agg(F.sum(order_value(mode)).alias("total_revenue"))


def kpi_median_store_revenue(t: ShopTables, year: int = 2022, mode: str = "reference") -> DataFrame:
    """Q11: lower median over stores of their item revenue in ``year``, truncated to an integer.

    Radix selection (the store sums are checkpointed), so no task holds all stores.
    """
    med = lower_median(store_item_revenue(t, year, mode), [], "total_revenue", "median_revenue", method="radix")
    return med.select(F.col("median_revenue").cast("long").alias("median_revenue"))


def first_order_years(t: ShopTables) -> DataFrame:
    """Year of each customer's first order (null customers excluded)."""
    return (t.orders.where(F.col("customerid").isNotNull())
            .groupBy("customerid").agg(F.year(F.min("orderdate")).alias("first_year")))


def kpi_new_customers(t: ShopTables, y0: int = 2021, y1: int = 2022) -> DataFrame:
    """Q12: customers whose first order falls in ``y0`` and in ``y1`` → new_customers_<y>."""
    f = first_order_years(t)
    return f.agg(*[F.count(F.when(F.col("first_year") == F.lit(int(y)), F.col("customerid")))
                   .alias(f"new_customers_{int(y)}") for y in (y0, y1)])


def kpi_revenue_per_year(t: ShopTables, years: Sequence[int] = (2021, 2022)) -> DataFrame:
    """Q13: Σ total per year → year, total_revenue."""
    return (t.orders_in(years)
            .groupBy(F.year("orderdate").alias("year")).agg(F.sum("total").alias("total_revenue"))
            .orderBy("year"))


def store_count(t: ShopTables):
    """Number of stores (scalar Column over the stores table; ``storeid`` is its key)."""
    return t.stores.select(F.count("storeid")).scalar()


def kpi_avg_store_revenue_per_year(t: ShopTables, years: Sequence[int] = (2021, 2022),
                                   n_stores: int | None = None) -> DataFrame:
    """Q14: Σ total per year divided by the number of stores.

    ``n_stores`` defaults to the size of the stores table; the dashboard
    used a fixed count, which can be passed instead.
    """
    n = F.lit(int(n_stores)) if n_stores else store_count(t)
    per_year = kpi_revenue_per_year(t, years)
    avg = F.try_divide(F.col("total_revenue").cast("double"), n.cast("double"))
    return per_year.select("year", avg.alias("avg_revenue_per_store"))


def kpi_summary(t: ShopTables, y0: int = 2021, y1: int = 2022, n_stores: int | None = None,
                mode: str = "reference", missing_year: int = 0) -> DataFrame:
    """Q15: one row of headline figures and their change from ``y0`` to ``y1``.

    Three aggregates read the orders: one by (store, year), folded into a
    struct of all revenue figures; the new-customer counts by customer (a
    struct of both years); the median by store over the items of ``y1``. A
    year without orders counts as ``missing_year`` (the dashboard used 1); a change against a zero base is
    null, except new customers, where it is 0.
    """
    y0, y1 = int(y0), int(y1)
    zero = F.lit(int(missing_year)).cast("decimal(22,2)")
    total = F.col("total")
    year = F.year("orderdate")
    per_store = t.orders.groupBy("storeid").agg(
        F.sum(total).alias("rev"), *[F.sum(F.when(year == y, total)).alias(f"rev{y}") for y in sorted({y0, y1})])
    sums = per_store.select(F.struct(
        F.sum("rev").alias("total"), F.try_divide(F.sum("rev").cast("double"), F.count("rev").cast("double")).alias("avg"),
        *[F.coalesce(F.sum(f"rev{y}"), zero).alias(f"y{y}") for y in sorted({y0, y1})])).scalar()
    first = first_order_years(t)
    nc = first.select(F.struct(*[F.count(F.when(F.col("first_year") == F.lit(y), F.col("customerid"))).alias(f"y{y}")
                                 for y in sorted({y0, y1})])).scalar()
    nc0, nc1 = nc.getField(f"y{y0}"), nc.getField(f"y{y1}")
    n = F.lit(int(n_stores)) if n_stores else store_count(t)
    rev0, rev1 = sums.getField(f"y{y0}"), sums.getField(f"y{y1}")
    avg0, avg1 = (F.try_divide(r.cast("double"), n.cast("double")) for r in (rev0, rev1))
    return t.spark.range(1).select(
        t.customers.select(F.count(F.lit(1))).scalar().alias("total_customers"),
        sums.getField("total").alias("total_revenue"),
        sums.getField("avg").alias("average_revenue_per_store"),
        kpi_median_store_revenue(t, y1, mode).scalar().alias(f"median_revenue_from_stores_{y1}"),
        nc0.alias(f"new_customers_{y0}"),
        nc1.alias(f"new_customers_{y1}"),
        rev1.alias(f"total_revenue_{y1}"),
        pct_change(rev0.cast("double"), rev1.cast("double")).alias("total_revenue_change"),
        avg1.alias(f"avg_revenue_per_store_{y1}"),
        pct_change(avg0, avg1).alias("avg_revenue_per_store_change"),
        F.when(nc0 == 0, F.lit(0.0)).otherwise(pct_change(nc0.cast("double"), nc1.cast("double")))
        .alias("new_customers_change"))


def kpi_cards(t: ShopTables, y0: int = 2021, y1: int = 2022, n_stores: int | None = None,
              mode: str = "reference", missing_year: int = 0) -> DataFrame:
    """Q37: the summary as four display strings."""
    s = kpi_summary(t, y0, y1, n_stores, mode, missing_year)
    y1 = int(y1)
    return s.select(
        F.concat(F.col(f"new_customers_{y1}").cast("string"), F.lit(" ("),
                 percent_text("new_customers_change"), F.lit(")")).alias("new_customers_card"),
        F.concat(millions_text(f"total_revenue_{y1}"), F.lit(" ("),
                 percent_text("total_revenue_change"), F.lit(")")).alias("total_revenue_card"),
        F.concat(millions_text(f"avg_revenue_per_store_{y1}"), F.lit(" ("),
                 percent_text("avg_revenue_per_store_change"), F.lit(")")).alias("avg_revenue_per_store_card"),
        millions_text(f"median_revenue_from_stores_{y1}").alias("median_revenue_card"))


def _monthly(t: ShopTables) -> DataFrame:
    per_month = t.orders.groupBy("storeid", month_key("orderdate").alias("month")) \
        .agg(F.sum("total").alias("revenue"))
    return with_store(t, per_month).select("storeid", "city", "latitude", "longitude", "month", "revenue")


def store_monthly_revenue(t: ShopTables) -> DataFrame:
    """Q16: revenue per store and ``yyyy-MM`` month (stores of the stores table)."""
    return _monthly(t).orderBy(F.asc_nulls_last("city"), "month", "storeid")


def store_monthly_revenue_map(t: ShopTables) -> DataFrame:
    """Q17: one row per store; ``monthly_revenues`` maps month → revenue, months ascending."""
    entries = F.sort_array(F.collect_list(F.struct("month", "revenue")))
    return (_monthly(t).groupBy("storeid", "city", "latitude", "longitude")
            .agg(F.map_from_entries(entries).alias("monthly_revenues"))
            .orderBy(F.asc_nulls_last("city"), "storeid"))


def store_monthly_filled(t: ShopTables, year: int = 2022, store=None) -> DataFrame:
    """Q18: monthly sales of ``year`` per store, months between the first and
    the last month with sales filled with 0 → storeid, month, month_name, sales, sales_label."""
    orders = known_stores(t, store_filter(t.orders_in([year]), store))
    per_month = orders.groupBy("storeid", F.trunc(F.to_date("orderdate"), "month").alias("month_start")) \
        .agg(F.sum("total").alias("sales"))
    filled = densify(per_month, ["storeid"], "month_start",
                     F.sequence(F.min("month_start"), F.max("month_start"), F.expr("INTERVAL 1 MONTH")),
                     {"sales": F.lit(0).cast("decimal(22,2)")})
    return filled.select("storeid", month_key("month_start").alias("month"),
                         month_name("month_start").alias("month_name"), "sales",
                         short_money("sales").alias("sales_label")).orderBy("storeid", "month")


def store_daily_filled(t: ShopTables, store=None) -> DataFrame:
    """Q18 by day over all years: sales per store and day, days without sales between the first and the last with 0.

    The domain has a row per store and day of the shop's life, so the gaps are
    filled from neighbouring days (:func:`storelens.operators.densify.fill_gaps`).
    """
    orders = known_stores(t, store_filter(t.orders, store)).where(F.col("orderdate").isNotNull())
    per_day = orders.groupBy("storeid", F.to_date("orderdate").alias("day")).agg(F.sum("total").alias("sales"))
    return fill_gaps(per_day, ["storeid"], "day", {"sales": 0}).orderBy("storeid", "day")


def sales_map(t: ShopTables, year: int = 2022) -> DataFrame:
    """Q35: stores with their revenue of ``year`` (0 when none), highest first."""
    of_year = (t.orders_in([year])
               .groupBy("storeid").agg(F.sum("total").alias("revenue")))
    stores = with_store(t, t.orders.select("storeid").distinct())  # stores with orders in any year: one column read
    return (stores.join(of_year, "storeid", "left")
            .select("storeid", "latitude", "longitude", "city", F.coalesce("revenue", F.lit(0)).alias("revenue"))
            .orderBy(F.desc_nulls_first("revenue"), "storeid"))


def stores_table(t: ShopTables, year: int = 2022, best: bool = True, k: int = 5) -> DataFrame:
    """Q36: the best (or worst) ``k`` stores of ``year`` as a table with money text."""
    ranked = top_stores(t, [year], k) if best else worst_stores(t, [year], k)
    # rows come ranked as in Q1/Q2; the table itself lists a missing revenue last
    order = F.desc_nulls_last("revenue") if best else F.asc_nulls_last("revenue")
    return ranked.select(F.col("storeid").alias("store"), F.col("annual_sales").alias("revenue"),
                         money_text("annual_sales").alias("revenue_label")) \
        .orderBy(order, "store").limit(k)

