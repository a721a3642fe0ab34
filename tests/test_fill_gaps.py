"""Gap rows from neighbouring keys."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from storelens.operators import fill_gaps
from storelens.session import plan_text


def test_small_groups(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 4, None, "y"), ("b", 7, 1, "z"), (None, -2, 3, "n"), (None, 0, 4, "m"), ("a", None, 9, "w")],
                               "g string, k int, v int, t string")
    got = sorted(map(tuple, fill_gaps(df, ["g"], "k", {"v": 0}).collect()), key=str)
    assert got == sorted([("a", 1, 5, "x"), ("a", 2, 0, None), ("a", 3, 0, None), ("a", 4, 0, "y"), ("b", 7, 1, "z"),
                          (None, -2, 3, "n"), (None, -1, 0, None), (None, 0, 4, "m")], key=str)
    assert fill_gaps(df, ["g"], "k", {}).schema["k"].dataType == df.schema["k"].dataType
    assert fill_gaps(df.where("false"), ["g"], "k", {"v": 0}).count() == 0
    every = fill_gaps(spark.createDataFrame([(0, 1), (6, 1), (7, 1)], "k long, v int"), [], "k", {"v": 0}, step=2)
    assert sorted(r.k for r in every.collect()) == [0, 2, 4, 6, 7]


def test_dates(spark):
    df = spark.createDataFrame([(1, date(2020, 2, 27), 5), (1, date(2020, 3, 2), 6)], "g int, d date, v int")
    got = sorted(map(tuple, fill_gaps(df, ["g"], "d", {"v": 0}).collect()))
    assert got == [(1, date(2020, 2, 27) + timedelta(k), v) for k, v in enumerate([5, 0, 0, 0, 6])]


def test_a_large_group_spreads(spark):
    """A million keys of one group, every third missing, and one gap of a hundred thousand."""
    ids = spark.range(1_000_000).where("id % 3 <> 1 and (id < 300000 or id >= 400000)")
    df = ids.select(F.lit("hot").alias("g"), F.col("id").alias("k"), F.lit(1).alias("v"))
    out = fill_gaps(df, ["g"], "k", {"v": 0})
    n, keys, ones, low, high = out.agg(F.count("k"), F.count_distinct("k"), F.sum("v"), F.min("k"), F.max("k")).first()
    assert (n, keys, ones, low, high) == (1_000_000, 1_000_000, df.count(), 0, 999_999)
    plan = plan_text(out)
    assert "collect_list" not in plan and "map_from" not in plan
