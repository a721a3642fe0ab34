"""Orders as a change feed."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import functions as F
from shop_fixtures import SF, D, make_tables

from storelens.plans import customers, sales, stores
from storelens.sources import apply_changes, latest_changes, read_tables, tables_from_tpch, with_changes, write_monthly_tables


def _feed(spark, orders, rows):
    """rows: (orderid, version, deleted, iso date, total); the other columns as in the first order."""
    kinds = dict(orders.dtypes)
    df = spark.createDataFrame([(o, v, d, None if t is None else datetime.fromisoformat(t), None if x is None else D(x)) for o, v, d, t, x in rows],
                               "orderid long, version int, deleted boolean, orderdate timestamp_ntz, total decimal(12,2)")
    return df.select("orderid", F.lit(1).cast(kinds["customerid"]).alias("customerid"), F.lit(1).cast(kinds["storeid"]).alias("storeid"),
                     "orderdate", F.lit(1).alias("nitems"), "total", "version", "deleted")


ORDERS = [(k, 1, 1, f"2021-0{1 + k % 4}-01T10:00", 1, 10) for k in range(1, 9)]
ROWS = [(1, 2, False, "2021-02-01T10:00", 50), (1, 1, False, "2021-02-01T10:00", 40), (1, 2, False, "2021-02-01T10:00", 50),  # repeated
        (2, 1, True, None, None), (2, 2, False, "2021-03-01T10:00", 7),     # deleted, then back
        (3, 1, False, "2021-12-01T10:00", 5), (3, 3, True, None, None),     # moved, then deleted
        (20, 1, False, "2022-01-01T10:00", 9), (21, 1, None, "2022-01-01T10:00", 1), (99, 1, True, None, None), (None, 5, True, None, None)]


def test_latest_versions(spark):
    t = make_tables(spark, orders=ORDERS)
    feed = _feed(spark, t.orders, ROWS)
    got = {r.orderid: (r.version, r.deleted, r.total) for r in latest_changes(feed.repartition(5)).collect()}
    assert got == {1: (2, False, D(50)), 2: (2, False, D(7)), 3: (3, True, None), 20: (1, False, D(9)), 21: (1, False, D(1)), 99: (1, True, None)}
    after = {r.orderid: r.total for r in with_changes(t, feed).orders.collect()}
    assert after == {1: D(50), 2: D(7), 20: D(9), 21: D(1), **{k: D(10) for k in range(4, 9)}}
    assert with_changes(t, feed.where("false")).orders.count() == 8


def test_months_are_rewritten_and_no_others(spark, tmp_path):
    t = make_tables(spark, orders=ORDERS)
    path = write_monthly_tables(t, f"{tmp_path}/shop", 2)
    stamp = lambda m: {f: os.path.getmtime(f"{path}/orders/order_month={m}/{f}") for f in os.listdir(f"{path}/orders/order_month={m}")}
    before = stamp(202101)
    feed = _feed(spark, t.orders, [r for r in ROWS if r[0] != 3])
    months = apply_changes(spark, read_tables(spark, path), path, feed)
    assert months == ["order_month=202102", "order_month=202103", "order_month=202201"] and stamp(202101) == before
    now = read_tables(spark, path)
    want = with_changes(t, feed)
    cols = want.orders.columns
    assert sorted(map(str, now.orders.select(*cols).collect())) == sorted(map(str, want.orders.collect()))
    # applied once more: the same table
    apply_changes(spark, now, path, feed)
    assert sorted(map(str, read_tables(spark, path).orders.select(*cols).collect())) == sorted(map(str, want.orders.collect()))
    # the last order of a month goes: so does its folder
    only = [r for r in read_tables(spark, path).orders_in([2022]).collect()]
    apply_changes(spark, read_tables(spark, path), path, _feed(spark, t.orders, [(r.orderid, 9, True, None, None) for r in only]))
    assert not os.path.exists(f"{path}/orders/order_month=202201") and not os.path.exists(f"{path}/_changing")


def test_reports_on_base_and_changes_equal_the_rewritten_table(spark, tmp_path):
    t = tables_from_tpch(spark, SF)
    path = write_monthly_tables(t, f"{tmp_path}/shop", 2)
    some = t.orders.where("orderid % 5 = 0")
    moved = some.select("orderid", "customerid", "storeid", (F.col("orderdate") + F.expr("interval 40 days")).alias("orderdate"),
                        "nitems", (F.col("total") + 1).cast("decimal(12,2)").alias("total"), F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    gone = some.where("orderid % 2 = 0").select("*", F.lit(2).alias("version"), F.lit(True).alias("deleted"))
    feed = moved.unionByName(gone)
    both = with_changes(t, feed)
    apply_changes(spark, read_tables(spark, path), path, feed, files=2)
    rewritten = read_tables(spark, path)
    for report in (lambda b: sales.top_stores(b, [1998, 1999]), stores.store_scatter, lambda b: customers.rfm_segments(b, 1999),
                   sales.store_monthly_revenue, sales.kpi_new_customers):
        assert sorted(map(str, report(both).collect())) == sorted(map(str, report(rewritten).collect()))
