"""Registry of the reports with their parameters on the TPC-H style test tables.

The reports' defaults are the dashboard's constants (years 2018–2022 and so
on). The test tables cover 1995–2001 (orders) and 2024 (events), so the
registry binds the same reports to years that hold data there; hour-of-day
reports read the events mapping, the only source with clock times.

``checked(df)`` is the form the correctness check compares: money as
DOUBLE, integers as BIGINT, nested results flattened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.plans import customers, products, sales, stores
from storelens.sources.changes import with_changes
from storelens.sources.tables import ShopTables, read_tables, write_tables
from storelens.sources.tpch import event_orders, tables_from_tpch

# Report parameters on the test tables.
PIVOT_YEARS = (1996, 1997, 1998, 1999, 2000)
RANK_YEARS = (1998, 1999, 2000)
YEAR = 2000
NEW_YEARS = (1996, 1997)
NAME_PATTERN = "%widget%"
EVENT_YEARS = (2024,)
STORE = 7
FIXED_STORES = 32


@dataclass(frozen=True)
class TestTables:
    t: ShopTables          # the five tables
    ev: ShopTables         # same dimensions, events as orders

    @property
    def twice(self) -> ShopTables:
        """The same tables with every order delivered a second time."""
        return self.t.with_orders(self.t.orders.unionByName(self.t.orders), repeated=True)

    @property
    def changed(self) -> ShopTables:
        """The same tables after a change feed: every order's total doubled, then those of 1998 deleted, delivered latest first."""
        o = self.t.orders
        doubled = o.withColumn("total", (F.col("total") * 2).cast(o.schema["total"].dataType)).select("*", F.lit(1).alias("version"), F.lit(False).alias("deleted"))
        gone = self.t.orders_in([1998]).select("*", F.lit(2).alias("version"), F.lit(True).alias("deleted"))
        return with_changes(self.t, gone.unionByName(doubled))


def _flat_map(df: DataFrame) -> DataFrame:
    return df.select("storeid", "city", "latitude", "longitude",
                     F.posexplode("monthly_revenues").alias("pos", "month", "revenue"))


def _flat_segments(df: DataFrame) -> DataFrame:
    return df.select("storeid", F.posexplode("rfm_data").alias("pos", "r")).select("storeid", "pos", "r.*")


def _round(cols, digits=6):
    def view(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])
    return view


# name -> (report on TestTables, view for the check or None)
REPORTS: dict[str, tuple[Callable[[TestTables], DataFrame], Callable | None]] = {
    "top_stores": (lambda d: sales.top_stores(d.t, RANK_YEARS), None),
    "worst_stores": (lambda d: sales.worst_stores(d.t, RANK_YEARS), None),
    "top_stores_changed": (lambda d: sales.top_stores(d.changed, RANK_YEARS), None),
    "store_locations": (lambda d: stores.store_locations(d.t), None),
    "customer_locations": (lambda d: customers.customer_locations(d.t), None),
    "store_annual_revenues": (lambda d: sales.store_annual_revenues(d.t, PIVOT_YEARS), None),
    "store_year_revenue": (lambda d: stores.store_year_revenue(d.t), None),
    "store_year_revenue_item": (lambda d: stores.store_year_revenue(d.t, mode="item"), None),
    "store_year_order_count": (lambda d: stores.store_year_order_count(d.t), None),
    "store_year_order_count_redelivered": (lambda d: stores.store_year_order_count(d.twice), None),
    "store_scatter_redelivered": (lambda d: stores.store_scatter(d.twice), None),
    "kpi_new_customers_redelivered": (lambda d: sales.kpi_new_customers(d.twice, *NEW_YEARS), None),
    "store_scatter": (lambda d: stores.store_scatter(d.t), None),
    "store_scatter_item": (lambda d: stores.store_scatter(d.t, mode="item"), None),
    "store_trend_item": (lambda d: stores.store_trend(d.t, mode="item"), _round({"slope", "intercept", "r2"})),
    "store_trend": (lambda d: stores.store_trend(d.t), _round({"slope", "intercept", "r2"})),
    "kpi_total_customers": (lambda d: customers.kpi_total_customers(d.t), None),
    "kpi_total_revenue": (lambda d: sales.kpi_total_revenue(d.t), None),
    "kpi_avg_revenue_per_store": (lambda d: sales.kpi_avg_revenue_per_store(d.t), None),
    "kpi_median_store_revenue": (lambda d: sales.kpi_median_store_revenue(d.t, YEAR), None),
    "kpi_median_store_revenue_item": (lambda d: sales.kpi_median_store_revenue(d.t, YEAR, mode="item"), None),
    "kpi_new_customers": (lambda d: sales.kpi_new_customers(d.t, *NEW_YEARS), None),
    "kpi_revenue_per_year": (lambda d: sales.kpi_revenue_per_year(d.t, NEW_YEARS), None),
    "kpi_avg_store_revenue_per_year": (lambda d: sales.kpi_avg_store_revenue_per_year(d.t, NEW_YEARS), None),
    "kpi_avg_store_revenue_per_year_fixed": (
        lambda d: sales.kpi_avg_store_revenue_per_year(d.t, NEW_YEARS, n_stores=FIXED_STORES), None),
    "kpi_summary_item": (lambda d: sales.kpi_summary(d.t, *NEW_YEARS, mode="item"), None),
    "kpi_summary": (lambda d: sales.kpi_summary(d.t, *NEW_YEARS), None),
    "kpi_cards": (lambda d: sales.kpi_cards(d.t, *NEW_YEARS), None),
    "store_monthly_revenue": (lambda d: sales.store_monthly_revenue(d.t), None),
    "store_monthly_revenue_map": (lambda d: sales.store_monthly_revenue_map(d.t), _flat_map),
    "store_monthly_filled": (lambda d: sales.store_monthly_filled(d.t, YEAR), None),
    "store_monthly_filled_store": (lambda d: sales.store_monthly_filled(d.t, YEAR, STORE), None),
    "store_daily_filled": (lambda d: sales.store_daily_filled(d.t), None),
    "category_orders": (lambda d: products.category_orders(d.t, RANK_YEARS, NAME_PATTERN), None),
    "revenue_by_product": (lambda d: products.revenue_by_product(d.t, RANK_YEARS), None),
    "revenue_share_by_product": (lambda d: products.revenue_share_by_product(d.t, RANK_YEARS), None),
    "repeat_customers": (lambda d: stores.repeat_customers(d.t), None),
    "repeat_customers_store": (lambda d: stores.repeat_customers(d.t, STORE), None),
    "store_ids": (lambda d: stores.store_ids(d.t), None),
    "product_size_sales": (lambda d: products.product_size_sales(d.t), None),
    "product_size_sales_item": (lambda d: products.product_size_sales(d.t, mode="item"), None),
    "orders_per_hour": (lambda d: stores.orders_per_hour(d.ev, EVENT_YEARS), None),
    "orders_per_hour_band": (lambda d: stores.orders_per_hour_band(d.ev, EVENT_YEARS), None),
    "orders_per_hour_band_store": (lambda d: stores.orders_per_hour_band(d.ev, EVENT_YEARS, STORE), None),
    "weekday_named_store": (lambda d: stores.weekday_named(d.t, YEAR, STORE), None),
    "revenue_per_weekday": (lambda d: stores.revenue_per_weekday(d.t, RANK_YEARS), None),
    "weekday_named": (lambda d: stores.weekday_named(d.t, YEAR), None),
    "product_boxplot": (lambda d: products.product_boxplot(d.t),
                        _round({"min", "lower_whisker", "q1", "median", "q3", "upper_whisker", "max", "iqr"})),
    "rfm_orders": (lambda d: customers.rfm_orders(d.t, YEAR), None),
    "rfm_orders_item": (lambda d: customers.rfm_orders(d.t, YEAR, mode="item"), None),
    "rfm_scores": (lambda d: customers.rfm_scores(d.t, YEAR), None),
    "rfm_scores_item": (lambda d: customers.rfm_scores(d.t, YEAR, mode="item"), None),
    "rfm_scores_unique_edges": (lambda d: customers.rfm_scores(d.t, YEAR, duplicates="raise"), None),
    "rfm_segments_store": (lambda d: customers.rfm_segments(d.t, YEAR, STORE), None),
    "rfm_segments": (lambda d: customers.rfm_segments(d.t, YEAR), None),
    "rfm_segments_nested": (lambda d: customers.rfm_segments_nested(d.t, YEAR), _flat_segments),
    "rfm_monetary_table": (lambda d: customers.rfm_monetary_table(d.t, YEAR), None),
    "sales_map": (lambda d: sales.sales_map(d.t, YEAR), None),
    "stores_table": (lambda d: sales.stores_table(d.t, YEAR, best=True), None),
    "stores_table_worst": (lambda d: sales.stores_table(d.t, YEAR, best=False), None),
}


def checked(df: DataFrame) -> DataFrame:
    """Money and fractions as DOUBLE, integers as BIGINT (the oracle's types)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_TABLES: dict[tuple[str, str], TestTables] = {}


def test_tables(spark: SparkSession, sf_dir: str) -> TestTables:
    """Lazy logical tables of ``sf_dir`` (memoised per session and folder,
    so the broadcast size checks run once)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        t = tables_from_tpch(spark, sf_dir)
        _TABLES[key] = TestTables(t, t.with_orders(event_orders(spark, sf_dir)))
    return _TABLES[key]


def materialize(spark: SparkSession, sf_dir: str, path: str) -> TestTables:
    """Write the mapped five tables (and the event orders) once under ``path``
    and use them for every later report on ``sf_dir`` in this session.

    This is the deployment layout: reports read stored tables instead of
    re-running the test-table mapping joins; orders are range-clustered by
    date so year ranges skip files and row groups.
    """
    lazy = tables_from_tpch(spark, sf_dir)
    root = write_tables(lazy, f"{path.rstrip('/')}/shop")
    event_orders(spark, sf_dir).repartitionByRange(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "orderdate", "orderid") \
        .sortWithinPartitions("orderdate", "orderid").write.parquet(f"{path.rstrip('/')}/event_orders")
    t = read_tables(spark, root)
    ev = t.with_orders(spark.read.parquet(f"{path.rstrip('/')}/event_orders"))
    _TABLES[(spark.sparkContext.applicationId, sf_dir)] = TestTables(t, ev)
    return _TABLES[(spark.sparkContext.applicationId, sf_dir)]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered report ``name`` on ``sf_dir``, in checked form."""
    report, view = REPORTS[name]
    df = report(test_tables(spark, sf_dir))
    if view is not None:
        df = view(df)
    return checked(df)
