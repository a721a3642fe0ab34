"""Every registered report against its DuckDB oracle, plus plan-shape checks."""

from __future__ import annotations

import re

import pytest
from shop_fixtures import SF

import __spark_entry__ as entry
from storelens.check import compare
from storelens.plans import catalog, sales
from storelens.session import plan_text
from storelens.sources import tables_from_tpch


def test_registry_and_oracle_keys():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(catalog.REPORTS) <= set(q)
    assert set(catalog.REPORTS) <= set(sql), "every report is SQL expressible and has an oracle"
    own = set(catalog.REPORTS) if entry.llm is None else set(catalog.REPORTS) | set(entry.llm.QUERIES) | {"pipeline"}
    assert set(q) == own and set(sql) <= own


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["storeid", "city", "latitude", "longitude"]


def test_all_reports_match_oracle(spark):
    res = compare(spark, SF, list(catalog.REPORTS))
    bad = {k: v for k, v in res.items() if not v.get("ok")}
    assert not bad, bad


def _plan(spark, name):
    return plan_text(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", sorted(catalog.REPORTS))
def test_no_python_and_no_unpartitioned_window(spark, name):
    plan = _plan(spark, name)
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct"):
        assert bad not in plan
    # a window without partition keys would put all rows in one task
    for line in plan.splitlines():
        if line.startswith("Arguments: [") and "windowspecdefinition(" in line:
            assert not re.search(r"windowspecdefinition\((ROWS|RANGE|specifiedwindowframe|[^,]*ASC|[^,]*DESC)",
                                 line), line


def test_year_range_reaches_scan(spark):
    plan = _plan(spark, "top_stores")
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan and "LessThan(o_orderdate,2001-01-01" in plan
    assert "WindowGroupLimit" in plan


def test_dimensions_broadcast_and_columns_pruned(spark):
    plan = _plan(spark, "rfm_orders")
    assert "BroadcastHashJoin LeftSemi" in plan          # known stores
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    plan = _plan(spark, "store_annual_revenues")
    assert "lineitem" not in plan                         # nitems unused: line counts pruned


def _scans(plan: str, table: str) -> int:
    return len(re.findall(rf"^Location: .*/{table}\.parquet\]", plan, re.M))


def test_rfm_reads_the_facts_once(spark, monkeypatch):
    from storelens.plans import customers
    from storelens.sources import tables_from_tpch
    t = tables_from_tpch(spark, SF)
    plan = plan_text(customers.customer_values(t, 2000))
    assert _scans(plan, "orders") == 1 and _scans(plan, "lineitem") == 2  # the test mapping counts lines for nitems
    made = []
    keep = type(t.orders).checkpoint
    monkeypatch.setattr(type(t.orders), "checkpoint", lambda self, *a, **k: made.append(1) or keep(self, *a, **k))
    plan = plan_text(customers.rfm_scores(t, 2000))
    assert len(made) == 1 and "parquet" not in plan.lower()  # quartiles of money need no second one
    # rows are ranked inside (store, value, partition), never a store as a whole; sums run over counts
    ranks = [x for x in plan.splitlines() if "row_number()" in x and x.startswith("Arguments")]
    assert ranks and all("_part#" in x for x in ranks)


def test_summary_reads_orders_three_times(spark):
    df = entry.queries()["kpi_summary"](spark, SF)
    df.collect()  # reused subqueries show once the plan is final
    found = lambda d: set(re.findall(r"/orders\.parquet\]\n(PushedFilters: .*)\n(ReadSchema: .*)", plan_text(d)))
    scans = found(df)
    assert len(scans) == 2, scans  # sums per store, first orders
    assert sum("o_totalprice" in schema for _, schema in scans) == 1
    # the third, the items of one year, is read for the checkpointed values of the median
    t = tables_from_tpch(spark, SF)
    third = found(sales.store_item_revenue(t, 1997))
    assert len(third) == 1 and "1997-01-01" in next(iter(third))[0]


@pytest.mark.parametrize("name, fact", [("store_monthly_filled", "orders"), ("orders_per_hour_band", "events")])
def test_densify_reads_the_fact_once(spark, name, fact):
    assert _scans(_plan(spark, name), fact) == 1


def test_nested_reports_sort_once(spark):
    for name in ("store_monthly_revenue_map", "rfm_segments_nested"):
        assert _plan(spark, name).count("rangepartitioning") <= 1


def test_hour_bands_sum_to_hours(spark):
    from pyspark.sql import functions as F
    hours = entry.queries()["orders_per_hour"](spark, SF)
    bands = entry.queries()["orders_per_hour_band"](spark, SF)
    a = hours.groupBy("storeid", "order_year").agg(F.sum("total_orders_per_hour").alias("n"))
    b = bands.groupBy("storeid", "order_year").agg(F.sum("total_orders").alias("n"), F.count("*").alias("k"))
    assert b.where("k != 6").count() == 0
    assert sorted(map(tuple, a.collect())) == sorted(tuple(r[:3]) for r in b.collect())


def test_session_time_zone_does_not_matter(spark):
    names = ["orders_per_hour", "orders_per_hour_band", "store_monthly_filled", "revenue_per_weekday",
             "rfm_scores", "kpi_new_customers"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        res = compare(spark, SF, names)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert all(v.get("ok") for v in res.values()), res
