"""The monthly layout (pruning, appends, compaction) and hot orders on bucketed tables."""

from __future__ import annotations

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F
from shop_fixtures import SF, make_tables, rows

from storelens.operators import heavy_keys, split_join
from storelens.plans import customers, products, sales, stores
from storelens.session import plan_text
from storelens.sources import (append_orders, compact_orders, read_catalog_tables, read_tables, tables_from_tpch,
                               write_bucketed_tables, write_monthly_tables)


def everything(t):
    years = [1998, 1999]
    reports = {"top": sales.top_stores(t, years), "monthly": sales.store_monthly_revenue(t), "filled": sales.store_monthly_filled(t, 1999),
               "products": products.revenue_by_product(t, years), "days": stores.revenue_per_weekday(t, years),
               "rfm": customers.rfm_segments(t, 1999), "scatter": stores.store_scatter(t), "sizes": products.product_size_sales(t),
               "category": products.category_orders(t, years, "%widget%"), "box": products.product_boxplot(t),
               "median": sales.kpi_median_store_revenue(t, 1999)}
    return {k: sorted(map(str, df.collect())) for k, df in reports.items()}


@pytest.fixture(scope="module")
def shop(spark):
    t = tables_from_tpch(spark, SF)
    return t, everything(t)


def test_monthly_layout_prunes_and_compacts(spark, tmp_path, shop):
    t, want = shop
    late = F.col("orderdate") >= F.lit("1999-06-01").cast("timestamp_ntz")
    path = write_monthly_tables(t.with_orders(t.orders.where(~late)), f"{tmp_path}/shop", 3)
    for part in range(3):  # three deliveries of the rest
        append_orders(t.orders.where(late & (F.pmod("orderid", F.lit(3)) == part)), path)
    months = [d for d in os.listdir(f"{path}/orders") if d.startswith("order_month=")]
    assert len(months) > 70 and "order_month=199907" in months
    m = read_tables(spark, path)
    assert everything(m) == want
    # a yearly report lists that year's folders only
    plan = plan_text(sales.yearly_store_sales(m, [1998]))
    assert re.search(r"PartitionFilters: \[.*order_month", plan)
    read = m.orders_in([1998]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {re.search(r"order_month=(\d{4})", r.f).group(1) for r in read} == {"1998"}
    # a join with a filtered table of months prunes at run time
    calendar = spark.range(1995 * 12, 2002 * 12).select(((F.col("id") / 12).cast("int") * 100 + F.col("id") % 12 + 1).cast("int").alias("order_month"))
    calendar.write.parquet(f"{tmp_path}/calendar")
    winter = spark.read.parquet(f"{tmp_path}/calendar").where("order_month % 100 = 1")
    assert "dynamicpruning" in plan_text(m.orders.join(F.broadcast(winter), "order_month").groupBy("storeid").count()).lower()
    # compaction: several files a month become one, the rows stay
    count = lambda month: len([f for f in os.listdir(f"{path}/orders/order_month={month}") if f.startswith("part-")])
    assert count(199907) == 3
    done = compact_orders(spark, path)
    assert "order_month=199907" in done and count(199907) == 1 and count(199802) == 1
    assert compact_orders(spark, path) == []
    again = read_tables(spark, path)
    assert everything(again) == want and not os.path.exists(f"{path}/_compacting")


def test_compaction_that_ended_between_the_renames(spark, tmp_path):
    t = make_tables(spark, orders=[(k, 1, 1, f"2021-0{1 + k % 3}-01T10:00", 1, 10) for k in range(9)])
    path = write_monthly_tables(t, f"{tmp_path}/shop", 1)
    os.makedirs(f"{path}/_compacting/new-x")
    os.rename(f"{path}/orders/order_month=202102", f"{path}/_compacting/old-order_month=202102")
    assert read_tables(spark, path).orders.count() == 6
    assert compact_orders(spark, path) == []
    assert read_tables(spark, path).orders.count() == 9


def _hot(spark):
    """One order with a third of all items."""
    orders = [(k, k % 5, 1 + k % 2, f"2021-0{1 + k % 9}-01T10:00", 2, 10) for k in range(400)]
    items = [(k % 400, 10 + k % 3) for k in range(4000)] + [(77, 10 + k % 3) for k in range(2000)]
    return make_tables(spark, orders=orders, items=items)


def test_heavy_keys(spark):
    t = _hot(spark)
    assert heavy_keys(t.orderitems, "orderid", 0.05) == [77]
    assert heavy_keys(t.orderitems, "orderid", 0.5) == []
    assert heavy_keys(t.orderitems.where("false"), "orderid") == []
    text = t.orderitems.select(F.concat(F.lit("o"), "orderid").alias("orderid"))
    assert heavy_keys(text, "orderid", 0.1) == ["o77"]
    assert heavy_keys(spark.createDataFrame([(None,), (1,)], "k int"), "k", 0.5) == [1]


def test_split_join_is_the_join(spark):
    many = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, v string")
    one = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "k int, w int")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one, "k", how).select("k", "v", "w").collect()))
        for hot in ([], [1], [1, 2, 9]):
            assert sorted(map(str, split_join(many, one, "k", hot, how).select("k", "v", "w").collect())) == want


def test_hot_order_on_bucketed_tables(spark, tmp_path):
    t = _hot(spark)
    want = {"rfm": rows(customers.rfm_orders(t, 2021)), "sizes": rows(products.product_size_sales(t)), "scatter": rows(stores.store_scatter(t))}
    tb = read_catalog_tables(spark, write_bucketed_tables(t, f"hot_{uuid.uuid4().hex[:8]}", f"{tmp_path}/shop", 4), hot_share=0.05)
    assert tb.hot_orders == (77,)
    got = {"rfm": rows(customers.rfm_orders(tb, 2021)), "sizes": rows(products.product_size_sales(tb)), "scatter": rows(stores.store_scatter(tb))}
    assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in saved:
            spark.conf.set(k, "-1")
        tb._small.update({"stores": True, "products": True})
        plan = plan_text(products.product_size_sales(tb)).split("\n\n")[0]
        # the cold rows meet bucket by bucket: no exchange below their sort-merge join
        join = plan[plan.index("SortMergeJoin"):plan.index("BroadcastHashJoin", plan.index("SortMergeJoin"))] \
            if "BroadcastHashJoin" in plan[plan.index("SortMergeJoin"):] else plan[plan.index("SortMergeJoin"):]
        assert "Exchange" not in join
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # rows that each task of the cold join reads: the hot order's are not among them
    cold = split_join(tb.orderitems, tb.orders.select("orderid", "nitems"), "orderid", tb.hot_orders).where("orderid <> 77")
    per_task = [r["count"] for r in cold.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 3990 and max(per_task) <= 2 * sorted(per_task)[len(per_task) // 2]
