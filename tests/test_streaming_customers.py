"""Incremental customer reports: after every batch equal to a full run, with work that follows the batch."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import functions as F
from shop_fixtures import SF, make_tables

from storelens.plans import customers, sales, stores
from storelens.sources import read_report, tables_from_tpch
from storelens.streaming import refresh_customers, valued_orders

YEAR = 2000


def run(spark, t, root, **kw):
    for q in refresh_customers(spark, f"{root}/orders", t.with_orders, f"{root}/out", rfm_year=kw.pop("year", YEAR),
                               checkpoint_location=f"{root}/ckpt", available_now=True, **kw):
        q.awaitTermination(600)
        assert q.exception() is None


def same(spark, root, t, year=YEAR):
    new = {r.first_year: r.new_customers for r in read_report(spark, f"{root}/out/new_customers").collect()}
    want = {r.first_year: r["count"] for r in sales.first_order_years(t).groupBy("first_year").count().collect()}
    assert new == want

    def rows(df, cols):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    for name, full in (("repeat_customers", stores.repeat_customers(t)), ("rfm_scores", customers.rfm_scores(t, year)),
                       ("rfm_segments", customers.rfm_segments(t, year))):
        cols = [F.col(c).cast("double") if k.startswith("decimal") else F.col(c) for c, k in full.dtypes]
        assert rows(read_report(spark, f"{root}/out/{name}"), cols) == rows(full, cols), name


def test_batches_equal_a_full_run(spark, tmp_path):
    t = tables_from_tpch(spark, SF)
    part = F.pmod(F.xxhash64("orderid"), F.lit(4))  # orders of all years arrive in any order
    late = F.col("orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    seen = t.orders.where("false")
    for some in ((part == 0) & ~late, (part > 0) & ~late, late):
        seen = seen.unionByName(t.orders.where(some))
        valued_orders(t.with_orders(t.orders.where(some))).coalesce(2).write.mode("append").parquet(f"{tmp_path}/orders")
        run(spark, t, tmp_path)
        same(spark, tmp_path, t.with_orders(seen))
    # the last batch has no order of the scored year: its changes are its own keys, no more
    state = f"{tmp_path}/out/_state"
    last = max(int(d) for d in os.listdir(f"{state}/_changes"))
    keys = t.orders.where(late).select("storeid", "customerid", F.year("orderdate")).distinct().count()
    assert spark.read.parquet(f"{state}/_changes/{last}").count() == keys
    # nothing new: nothing is written
    before = os.listdir(f"{state}/_changes")
    run(spark, t, tmp_path)
    assert os.listdir(f"{state}/_changes") == before


ORDERS = [(1, 1, 1, "2021-03-01T10:00", 1, 10), (2, 1, 1, "2021-04-01T10:00", 1, 20), (3, 2, 2, "2021-03-01T10:00", 1, 30),
          (4, None, 1, "2021-05-01T10:00", 1, 5), (5, 3, 9, "2021-05-01T10:00", 1, 5), (6, 2, 2, "2020-12-31T23:59", 1, 7),
          (7, 2, 2, "2021-06-01T00:00", 2, 7), (8, 4, None, "2021-06-01T00:00", 1, 7)]


def test_nulls_unknown_stores_and_late_first_orders(spark, tmp_path):
    t = make_tables(spark, orders=ORDERS, items=[(1, 10), (2, 10), (3, 11), (4, 10), (5, 10), (6, 12), (7, 11), (7, 99), (8, 10)])
    for k, ids in enumerate([[7, 8], [5, 6], [3, 4], [1, 2]]):  # the latest orders first
        valued_orders(t).where(F.col("orderid").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders")
        if k != 1:
            run(spark, t, tmp_path, year=2021, max_files=1)  # a batch per file
    same(spark, tmp_path, t, 2021)


def test_hot_customer_is_added_up_before_the_shuffle(spark):
    from storelens.streaming.customers import _added_up
    rows = spark.range(20_000).select(
        F.col("id").alias("orderid"), F.lit(1).alias("customerid"), F.lit(1).alias("storeid"),
        F.lit(datetime(2021, 1, 1)).cast("timestamp_ntz").alias("orderdate"), F.lit(2).cast("decimal(12,2)").alias("value")).coalesce(2)
    got = _added_up(rows).collect()
    assert len(got) <= 4 and sum(r.n for r in got) == 20_000 and sum(r.vsum for r in got) == 40_000
