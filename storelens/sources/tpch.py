"""Five logical tables from TPC-H style tables (the test data layout).

A nation plays the store and its region the city; customers keep their key;
an order's store is its customer's nation; ``nitems`` is the order's line
count; a line item is one order item of the part. Coordinates have no
counterpart and are derived from keys. The hour-of-day reports need real
clock times, which only ``events`` has, so :func:`event_orders` maps events
to orders.

``MAPPING_SQL`` is the same mapping as SQL text; it runs unchanged in Spark
SQL and DuckDB and is the prefix of every oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.joins import join_dim
from storelens.sources.tables import ShopTables

# The mapping of test tables to the five logical tables.
MAPPING_SQL = {
    "stores": "SELECT n_nationkey AS storeid, r_name AS city, CAST(25 + n_nationkey AS DOUBLE) AS latitude, "
              "CAST(-120 + 2 * n_nationkey AS DOUBLE) AS longitude FROM nation JOIN region ON n_regionkey = r_regionkey",
    "customers": "SELECT c_custkey AS customerid, CAST(25 + c_custkey % 25 AS DOUBLE) AS latitude, "
                 "CAST(-120 + c_custkey % 50 AS DOUBLE) AS longitude FROM customer",
    "shop_orders": "SELECT o_orderkey AS orderid, o_custkey AS customerid, c_nationkey AS storeid, "
                   "o_orderdate AS orderdate, CAST(COALESCE(n, 0) AS INT) AS nitems, "
                   "CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey "
                   "LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) i "
                   "ON l_orderkey = o_orderkey",
    "orderitems": "SELECT l_orderkey AS orderid, l_partkey AS sku FROM lineitem",
    "products": "SELECT p_partkey AS sku, p_name AS name, p_type AS category, p_size AS size, "
                "CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part",
    "event_orders": "SELECT event_id AS orderid, user_id AS customerid, user_id % 25 AS storeid, ts AS orderdate, "
                    "1 AS nitems, CAST(value AS DECIMAL(12,2)) AS total FROM events",
}
# Number of stores in the event mapping (user_id modulo this).
EVENT_STORES = 25


def mapping_cte() -> str:
    """``WITH`` clause defining the logical tables for an oracle query."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in MAPPING_SQL.items()) + "\n"


def _reader(spark: SparkSession, sf_dir: str):
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return read


def tables_from_tpch(spark: SparkSession, sf_dir: str) -> ShopTables:
    """Lazy logical tables over ``{sf_dir}/{nation,region,customer,orders,lineitem,part}.parquet``."""
    read = _reader(spark, sf_dir)
    nation, region, customer = read("nation"), read("region"), read("customer")
    orders, lineitem, part = read("orders"), read("lineitem"), read("part")

    # nation and region are a few rows; Catalyst's size estimate broadcasts them.
    stores = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("storeid"), F.col("r_name").alias("city"),
        (F.lit(25) + F.col("n_nationkey")).cast("double").alias("latitude"),
        (F.lit(-120) + 2 * F.col("n_nationkey")).cast("double").alias("longitude"))
    customers = customer.select(
        F.col("c_custkey").alias("customerid"),
        (F.lit(25) + F.col("c_custkey") % 25).cast("double").alias("latitude"),
        (F.lit(-120) + F.col("c_custkey") % 50).cast("double").alias("longitude"))

    # Line count per order. A left join to a frame unique on the key is
    # removed by Catalyst when a report does not read nitems.
    lines = lineitem.groupBy(F.col("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    cust_store = customer.select(F.col("c_custkey"), F.col("c_nationkey"))
    shop_orders = (
        join_dim(orders, cust_store, orders.o_custkey == cust_store.c_custkey)
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(F.col("o_orderkey").alias("orderid"), F.col("o_custkey").alias("customerid"),
                F.col("c_nationkey").alias("storeid"), F.col("o_orderdate").alias("orderdate"),
                F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("nitems"),
                F.col("o_totalprice").cast("decimal(12,2)").alias("total")))
    orderitems = lineitem.select(F.col("l_orderkey").alias("orderid"), F.col("l_partkey").alias("sku"))
    products = part.select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"),
                           F.col("p_type").alias("category"), F.col("p_size").alias("size"),
                           F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    return ShopTables(stores, customers, shop_orders, orderitems, products).check()


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with clock times: one event is an order of one item."""
    events = _reader(spark, sf_dir)("events")
    return events.select(
        F.col("event_id").alias("orderid"), F.col("user_id").alias("customerid"),
        (F.col("user_id") % EVENT_STORES).alias("storeid"), F.col("ts").alias("orderdate"),
        F.lit(1).alias("nitems"), F.col("value").cast("decimal(12,2)").alias("total"))
