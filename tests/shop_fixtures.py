"""Small shop tables for the tests (a plain module: two conftest files exist)."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T

from storelens.sources.tables import ShopTables

SF = "/root/testdata/sf0.001"

STORES = T.StructType([T.StructField("storeid", T.IntegerType()), T.StructField("city", T.StringType()),
                       T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
CUSTOMERS = T.StructType([T.StructField("customerid", T.LongType()), T.StructField("latitude", T.DoubleType()),
                          T.StructField("longitude", T.DoubleType())])
ORDERS = T.StructType([T.StructField("orderid", T.LongType()), T.StructField("customerid", T.LongType()),
                       T.StructField("storeid", T.IntegerType()), T.StructField("orderdate", T.TimestampNTZType()),
                       T.StructField("nitems", T.IntegerType()), T.StructField("total", T.DecimalType(12, 2))])
ITEMS = T.StructType([T.StructField("orderid", T.LongType()), T.StructField("sku", T.LongType())])
PRODUCTS = T.StructType([T.StructField("sku", T.LongType()), T.StructField("name", T.StringType()),
                         T.StructField("category", T.StringType()), T.StructField("size", T.IntegerType()),
                         T.StructField("price", T.DecimalType(12, 2))])


def D(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def make_tables(spark, stores=None, customers=None, orders=(), items=(), products=None) -> ShopTables:
    """Small bundle; orders are (orderid, customerid, storeid, 'iso time', nitems, total)."""
    stores = stores if stores is not None else [(1, "A", 1.0, 2.0), (2, "B", 3.0, 4.0)]
    customers = customers if customers is not None else [(c, 1.0, 1.0) for c in range(1, 11)]
    products = products if products is not None else [(10, "Margherita Pizza", "Classic", 1, D(10)),
                                                      (11, "Pepperoni Pizza", "Classic", 2, D(12)),
                                                      (12, "Salad", "Side", 1, D(5))]
    orows = [(o, c, s, ts(d), n, D(tot)) for (o, c, s, d, n, tot) in orders]
    return ShopTables(
        spark.createDataFrame(stores, STORES), spark.createDataFrame(customers, CUSTOMERS),
        spark.createDataFrame(orows, ORDERS), spark.createDataFrame(list(items), ITEMS),
        spark.createDataFrame(products, PRODUCTS)).check()


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
