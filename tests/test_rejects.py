"""The rejects table of text sources."""

import pytest
from shop_fixtures import D, make_tables

from storelens.plans import sales
from storelens.sources import read_tables, read_with_rejects, reject_counts


def _folder(spark, path, orders, fmt="csv"):
    t = make_tables(spark, orders=[(1, 1, 1, "2021-01-01 00:00:00", 1, 10)])
    for name in ("stores", "customers", "orderitems", "products"):
        getattr(t, name).write.format(fmt).save(f"{path}/{name}")
    spark.createDataFrame([(r,) for r in orders], "value string").coalesce(1).write.text(f"{path}/orders")


ROWS = ["1,7,1,2021-01-01 00:00:00,1,12.50", "2,7,1,yesterday,many,a lot", "x,7,1,2021-01-01 00:00:00,1,3.00",
        "4,7,1,2021-01-02 00:00:00,99999999999,5", "5,,1,2021-01-03 00:00:00,2,7.119", "6,7,1,2021-01-03 00:00:00,2,8.00,extra,more",
        "7,7,1,2021-01-03 00:00:00, ,1e12"]


def test_kept_and_left_out_are_all_rows(spark, tmp_path):
    _folder(spark, tmp_path, ROWS)
    got = read_with_rejects(spark, str(tmp_path), types={"stores": {"storeid": "int"}, "orders": {"storeid": "int"}})
    counts = {r.table: (r.read, r.kept, r.left_out) for r in got.counts.collect()}
    assert counts["orders"] == (7, 5, 2)  # a key that is no number, a record with more columns
    assert counts["stores"] == (2, 2, 0) and counts["customers"] == (10, 10, 0)
    orders = {r.orderid: r for r in got.tables.orders.collect()}
    assert set(orders) == {1, 2, 4, 5, 7}
    assert orders[1].total == D(12.5) and orders[2].orderdate is None and orders[4].nitems is None
    assert orders[5].customerid is None and orders[5].total == D("7.12")  # missing and rounded values are no rejects
    rejects = sorted((r.column or "", r.raw, r.reason, r.kept) for r in got.rejects.collect())
    assert rejects == sorted([
        ("nitems", "99999999999", "not within int", True), ("nitems", "many", "not a number", True),
        ("nitems", " ", "empty", True), ("orderdate", "yesterday", "not a date", True), ("orderid", "x", "not a number", False),
        ("total", "a lot", "not a number", True), ("total", "1e12", "not within decimal(12,2)", True),
        ("", "6,7,1,2021-01-03 00:00:00,2,8.00,extra,more", "broken record", False)])
    per = {(r.column, r.reason): r["values"] for r in reject_counts(got.rejects).collect()}
    assert per["nitems", "not a number"] == 1 and sum(per.values()) == 8
    assert got.rejects.where("table = 'orders' and file like '%/orders/%' and row is not null").count() == 8


def test_json_and_clean_tables(spark, tmp_path):
    _folder(spark, tmp_path, ['{"orderid": 1, "customerid": "7", "storeid": 1, "orderdate": "2021-01-01T00:00:00", "nitems": 1, "total": 12.5}',
                              '{"orderid": 2, "total": "free"}', '{"orderid": 3, "tot'], "json")
    types = {"stores": {"storeid": "int"}, "orders": {"storeid": "int"}}
    got = read_with_rejects(spark, str(tmp_path), fmt="json", types=types)
    assert {r.table: (r.kept, r.left_out) for r in got.counts.collect()}["orders"] == (2, 1)
    assert sorted((r.column or "", r.reason) for r in got.rejects.collect()) == [("", "broken record"), ("total", "not a number")]
    assert sales.kpi_total_revenue(got.tables).first()[0] == D(12.5)
    with pytest.raises(ValueError, match="text formats"):
        read_with_rejects(spark, str(tmp_path), fmt="parquet")


def test_without_rejects_the_tables_are_those_of_read_tables(spark, tmp_path):
    _folder(spark, tmp_path, ROWS[:1])
    got = read_with_rejects(spark, str(tmp_path))
    assert got.rejects.count() == 0
    plain = read_tables(spark, str(tmp_path), fmt="csv")
    for name in ("stores", "orders", "products"):
        assert sorted(map(tuple, getattr(got.tables, name).collect())) == sorted(map(tuple, getattr(plain, name).collect()))
