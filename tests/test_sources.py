"""Sources, schema checks and the report sink."""

from __future__ import annotations

import os
import tempfile

import pytest
from shop_fixtures import SF, D, make_tables
from pyspark.sql import functions as F

from storelens.plans import sales
from storelens.sources import (ShopTables, jdbc_options, json_rows, read_report, read_tables, tables_from_tpch,
                               write_report, write_tables)
from storelens.session import plan_text


def test_tpch_mapping_types(spark):
    t = tables_from_tpch(spark, SF)
    types = dict(t.orders.dtypes)
    assert types["orderdate"] == "timestamp_ntz" and types["total"] == "decimal(12,2)"
    assert types["nitems"] == "int"
    assert t.is_small("stores") and t.is_small("products")
    # nitems is the order's line count
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").count()
    j = t.orders.join(lines, F.col("orderid") == F.col("l_orderkey"))
    assert j.where(F.col("nitems") != F.col("count")).count() == 0


def test_schema_check_rejects(spark):
    t = make_tables(spark)
    bad = t.with_orders(t.orders.withColumn("total", F.col("total").cast("double")))
    with pytest.raises(ValueError, match="orders.total"):
        bad.check()
    with pytest.raises(ValueError, match="missing"):
        t.with_orders(t.orders.drop("nitems")).check()


def test_write_and_read_tables_and_report(spark):
    t = make_tables(spark, orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10), (2, 1, 2, "2022-01-01 00:00:00", 1, 5)])
    root = tempfile.mkdtemp(prefix="storelens-test-", dir=os.environ.get("TMPDIR", "/tmp"))
    for name in ("stores", "customers", "orders", "orderitems", "products"):
        getattr(t, name).write.parquet(f"{root}/tables/{name}")
    t2 = read_tables(spark, f"{root}/tables")
    rep = sales.yearly_store_sales(t2, [2021, 2022])
    path = write_report(rep, f"{root}/report", partition_by=["year"])
    back = read_report(spark, path)
    assert sorted(tuple(r) for r in back.select("storeid", "year", "annual_sales").collect()) == \
        sorted(tuple(r) for r in rep.select("storeid", "year", "annual_sales").collect())
    assert sorted(d for d in os.listdir(path) if d.startswith("year=")) == ["year=2021", "year=2022"]


def test_write_tables_layout_and_reports_agree(spark):
    root = tempfile.mkdtemp(prefix="storelens-layout-", dir=os.environ.get("TMPDIR", "/tmp"))
    t = tables_from_tpch(spark, SF)
    t2 = read_tables(spark, write_tables(t, f"{root}/shop", files_per_table=4))
    a = sorted(tuple(r) for r in sales.top_stores(t, [1998, 1999, 2000]).collect())
    b = sorted(tuple(r) for r in sales.top_stores(t2, [1998, 1999, 2000]).collect())
    assert a == b
    plan = plan_text(sales.yearly_store_sales(t2, [1998]))
    assert "PushedFilters: [IsNotNull(orderdate), GreaterThanOrEqual(orderdate,1998-01-01" in plan


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_text_formats_round_trip(spark, tmp_path, fmt):
    t = tables_from_tpch(spark, SF)
    for name in ("stores", "customers", "orders", "orderitems", "products"):
        getattr(t, name).write.format(fmt).save(f"{tmp_path}/{name}")
    keys = {"stores": {"storeid": "int"}, "orders": {"storeid": "int"}}
    want = sorted(map(tuple, sales.top_stores(t, [1998, 1999, 2000]).collect()))
    for coerce in (False, True):
        t2 = read_tables(spark, str(tmp_path), fmt=fmt, types=keys, coerce=coerce)
        assert sorted(map(tuple, sales.top_stores(t2, [1998, 1999, 2000]).collect())) == want


def test_coerced_values_become_null(spark, tmp_path):
    t = make_tables(spark, orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10)])
    for name in ("stores", "customers", "orderitems", "products"):
        getattr(t, name).write.csv(f"{tmp_path}/{name}")
    spark.createDataFrame([("1,7,A,2021-01-01 00:00:00,1,12.50",), ("2,7,A,yesterday,many,a lot",)], "value string") \
        .coalesce(1).write.text(f"{tmp_path}/orders")
    got = read_tables(spark, str(tmp_path), fmt="csv", coerce=True).orders.orderBy("orderid").collect()
    assert got[0].total == D(12.5) and got[0].nitems == 1
    assert got[1].orderdate is None and got[1].nitems is None and got[1].total is None


def test_one_date_spreads_over_files(spark, tmp_path):
    t = make_tables(spark, orders=[(k, 1, 1, "2021-01-01 00:00:00", 1, 10) for k in range(400)])
    write_tables(t, str(tmp_path), files_per_table=4)
    files = [f for f in os.listdir(f"{tmp_path}/orders") if f.startswith("part-")]
    assert len(files) == 4


def test_repeated_keys_are_found(spark):
    t = make_tables(spark, orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10)] * 2)
    with pytest.raises(ValueError, match="orders.orderid"):
        t.check_keys()
    make_tables(spark, orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10)]).check_keys()


def test_jdbc_options():
    one = jdbc_options("jdbc:x", "stores", {"user": "u"}, {"stores": "shop.stores"})
    assert one == {"url": "jdbc:x", "dbtable": "shop.stores", "preferTimestampNTZ": "true", "user": "u"}
    parts = {"orders": {"partitionColumn": "orderid", "lowerBound": 0, "upperBound": 99, "numPartitions": 8}}
    assert jdbc_options("jdbc:x", "orders", partitions=parts)["numPartitions"] == "8"
    assert "numPartitions" not in jdbc_options("jdbc:x", "stores", partitions=parts)
    with pytest.raises(ValueError, match="orders"):
        jdbc_options("jdbc:x", "orders", partitions={"orders": {"partitionColumn": "orderid"}})


def test_a_failed_overwrite_keeps_the_report(spark, tmp_path):
    path = f"{tmp_path}/report"
    write_report(spark.range(3), path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        write_report(bad, path)
    assert read_report(spark, path).count() == 3
    write_report(read_report(spark, path).where("id > 0"), path)  # a report made from itself
    assert read_report(spark, path).count() == 2
    assert [f for f in os.listdir(tmp_path) if "-old-" in f] == []


def test_cli_types(spark):
    from storelens import cli
    t = make_tables(spark, stores=[(1, "A", 1.0, 2.0)], orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10)])
    assert cli.build("top_stores", t, cli.parse_params(["years=2021"])).count() == 1
    assert cli.build("repeat_customers", t, cli.parse_params(["store=1"])).count() == 0
    assert cli.build("stores_table", t, cli.parse_params(["year=2021", "best=false", "k=2"])).count() == 1
    text = ShopTables(t.stores.withColumn("storeid", F.lit("007")), t.customers,
                      t.orders.withColumn("storeid", F.lit("007")), t.orderitems, t.products)
    got = cli.build("weekday_named", text, cli.parse_params(["year=2021", "store=007"])).collect()
    assert [r.storeid for r in got] == ["007"]
    with pytest.raises(SystemExit):
        cli.build("top_stores", t, cli.parse_params(["k=many"]))


def test_json_rows(spark):
    import json
    t = make_tables(spark, orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10)])
    recs = [json.loads(r["json"]) for r in json_rows(sales.top_stores(t, [2021])).collect()]
    assert recs == [{"storeid": 1, "year": 2021, "annual_sales": 10.0, "rank": 1}]


def test_cli_lists_and_runs_reports(spark, capsys):
    from storelens import cli
    assert {"top_stores", "rfm_segments", "store_monthly_filled", "kpi_cards"} <= set(cli.REPORTS)
    assert cli.main(["list"]) == 0
    assert "top_stores(years, k)" in capsys.readouterr().out
    out = tempfile.mkdtemp(prefix="storelens-cli-", dir=os.environ.get("TMPDIR", "/tmp"))
    assert cli.main(["run", "top_stores", "--tpch", SF, "--param", "years=1998,1999", "--param", "k=3",
                     "--out", f"{out}/top", "--format", "json"], spark=spark) == 0
    got = spark.read.json(f"{out}/top")
    assert got.count() == 6 and set(got.columns) == {"storeid", "year", "annual_sales", "rank"}
    with pytest.raises(SystemExit):
        cli.main(["run", "top_stores", "--tpch", SF, "--param", "bogus=1"], spark=spark)


def test_bucketed_layout_joins_orders_and_items_without_shuffle(spark):
    import uuid

    from storelens.plans import customers
    from storelens.sources import read_catalog_tables, write_bucketed_tables
    root = tempfile.mkdtemp(prefix="storelens-bucket-", dir=os.environ.get("TMPDIR", "/tmp"))
    db = f"shop_{uuid.uuid4().hex[:8]}"
    t = tables_from_tpch(spark, SF)
    tb = read_catalog_tables(spark, write_bucketed_tables(t, db, f"{root}/shop", 4))
    assert sorted(map(tuple, customers.rfm_orders(tb, 2000).collect())) == \
        sorted(map(tuple, customers.rfm_orders(t, 2000).collect()))
    for name in ("orders", "orderitems"):
        files = [f for _, _, fs in os.walk(f"{root}/shop/{name}") for f in fs if f.startswith("part-")]
        assert len(files) <= 4
    # as if the tables were too large to broadcast: a sort-merge join with no exchange
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                                   "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in saved:
            spark.conf.set(k, "-1")
        tb._small.update({"stores": True, "products": True})
        df = customers.rfm_orders(tb, 2000)
        df.collect()
        tree = plan_text(df).split("\n\n")[0].split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in tree
        assert tree.count("Exchange") == tree.count("BroadcastExchange")
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_materialized_registry_matches_lazy(spark):
    from pyspark.sql import SparkSession

    from storelens.plans import catalog
    root = tempfile.mkdtemp(prefix="storelens-mat-", dir=os.environ.get("TMPDIR", "/tmp"))
    names = ["top_stores", "store_scatter", "orders_per_hour_band", "rfm_segments"]
    lazy = {n: sorted(map(tuple, catalog.run(n, spark, SF).collect())) for n in names}
    other = SparkSession.builder.getOrCreate()  # same session object
    key = (other.sparkContext.applicationId, SF)
    before = catalog._TABLES.get(key)
    try:
        catalog.materialize(other, SF, f"{root}/tables")
        for n in names:
            assert sorted(map(tuple, catalog.run(n, other, SF).collect())) == lazy[n], n
    finally:
        if before is not None:
            catalog._TABLES[key] = before
        else:
            catalog._TABLES.pop(key, None)
