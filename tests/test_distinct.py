"""Mergeable exact distinct counts, and re-delivered orders."""

import pytest
from pyspark.sql import functions as F
from shop_fixtures import make_tables, rows

from storelens.operators.distinct import distinct_counts, distinct_state, merge_distinct, state_counts, state_form
from storelens.plans import sales, stores
from storelens.sources import read_tables, write_tables


def _ids(spark, n=5000):
    return spark.range(n).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 2000).alias("k"),
                                 F.concat(F.lit("t"), F.xxhash64("id") % 900).alias("s"))


@pytest.mark.parametrize("key, form", [("k", "bitmap"), ("k", "set"), ("s", "set"), ("k", None)])
def test_states_of_halves_merge_to_the_whole(spark, key, form):
    df = _ids(spark)  # negative, zero and repeated ids
    want = sorted(map(tuple, df.groupBy("g").agg(F.count_distinct(key).alias("n")).collect()))
    assert sorted(map(tuple, distinct_counts(df, ["g"], key, "n", form).collect())) == want
    form = form or state_form(df, ["g"], key)
    parts = [distinct_state(df.where(w), ["g"], key, form) for w in ("k % 2 = 0", "k % 2 <> 0", "k > 500")]
    whole = merge_distinct(*parts)
    assert sorted(map(tuple, state_counts(whole, ["g"], "n").collect())) == want
    # a row delivered again changes nothing
    again = merge_distinct(whole, distinct_state(df, ["g"], key, form))
    assert sorted(map(tuple, state_counts(again, ["g"], "n").collect())) == want


def test_state_survives_storage(spark, tmp_path):
    df = _ids(spark)
    distinct_state(df.where("g = 1"), ["g"], "k", "bitmap").write.parquet(f"{tmp_path}/a")
    kept = spark.read.parquet(f"{tmp_path}/a")
    both = merge_distinct(kept, distinct_state(df, ["g"], "k", "bitmap"))
    want = sorted(map(tuple, df.groupBy("g").agg(F.count_distinct("k")).collect()))
    assert sorted(map(tuple, state_counts(both, ["g"]).collect())) == want


def test_nulls_and_extremes(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 0), ("b", big), ("b", -big), ("b", 0), (None, 5)], "g string, k long")
    for form in ("bitmap", "set"):
        got = {r.g: r.n for r in distinct_counts(df, ["g"], "k", "n", form).collect()}
        assert got == {"a": 0, "b": 3, None: 1}
    assert distinct_counts(df.where("false"), ["g"], "k").count() == 0
    with pytest.raises(ValueError, match="whole-number"):
        distinct_state(df.select("g", F.lit("x").alias("k")), ["g"], "k", "bitmap")


def test_form_follows_density(spark):
    dense = spark.range(100_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    sparse = spark.range(2000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("k"))
    assert (state_form(dense, ["g"], "k"), state_form(sparse, ["g"], "k")) == ("bitmap", "set")


ORDERS = [(1, 1, 1, "2021-03-01T10:00", 1, 10), (2, 1, 1, "2021-04-01T10:00", 1, 20), (3, 2, 2, "2022-03-01T10:00", 1, 30),
          (4, None, 1, "2022-05-01T10:00", 1, 5), (5, 3, 9, "2022-05-01T10:00", 1, 5)]


def test_redelivered_orders(spark):
    once = make_tables(spark, orders=ORDERS, items=[(1, 10), (2, 10), (3, 11)])
    twice = once.with_orders(once.orders.unionByName(once.orders.where("orderid <> 3")), repeated=True)
    assert sorted(rows(stores.store_year_order_count(twice))) == sorted(rows(stores.store_year_order_count(once)))
    assert rows(sales.kpi_new_customers(twice)) == rows(sales.kpi_new_customers(once)) == [(1, 2)]
    counts = {(r.storeid, r.year): r.order_count for r in stores.store_scatter(twice).collect()}
    assert counts == {(1, 2021): 2, (2, 2022): 1}


def test_readers_settle_the_keys(spark, tmp_path):
    once = make_tables(spark, orders=ORDERS)
    write_tables(once.with_orders(once.orders.unionByName(once.orders)), f"{tmp_path}/twice", 2)
    assert read_tables(spark, f"{tmp_path}/twice").repeated == {"orders"}
    assert read_tables(spark, f"{tmp_path}/twice", keys="trust").repeated == frozenset()
    assert read_tables(spark, f"{tmp_path}/twice", keys="repeated").repeated == {"orders"}
    with pytest.raises(ValueError, match="keys must be"):
        read_tables(spark, f"{tmp_path}/twice", keys="maybe")
    write_tables(make_tables(spark, stores=[(1, "A", 1.0, 1.0), (1, "B", 1.0, 1.0)], orders=ORDERS), f"{tmp_path}/bad", 2)
    with pytest.raises(ValueError, match=r"stores.storeid repeats \[1\]"):
        read_tables(spark, f"{tmp_path}/bad")
