"""Operators against pandas and hand-worked values."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.dates import in_years, local_hour, weekday_name, whole_days
from storelens.functions.text import money_text, percent_text, short_money
from storelens.operators.densify import densify, pct_change
from storelens.operators.joins import fits_broadcast, join_dim
from storelens.operators.quantiles import boxplot_stats, lower_median, qcut_rank, qcut_value, quantile_edges
from storelens.operators.ranking import class_rank, group_rank, range_tagged, top_k

SCHEMA = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("id", T.LongType()),
                       T.StructField("x", T.DoubleType())])


def _series(seed: int):
    rnd = random.Random(seed)
    data = []
    for g in range(6):
        n = rnd.randint(2, 60)
        kind = rnd.choice(["int", "money", "ties"])
        for i in range(n):
            if kind == "int":
                x = float(rnd.randint(1, 365))
            elif kind == "money":
                x = round(rnd.uniform(1, 5000), 2)
            else:
                x = float(rnd.choice([1, 2, 3, 5, 8]))
            data.append((g, i, x))
    return data


def _pandas_qcut(data, reverse=False):
    out = {}
    pdf = pd.DataFrame(data, columns=["g", "id", "x"])
    for g, grp in pdf.groupby("g"):
        try:
            labels = [4, 3, 2, 1] if reverse else [1, 2, 3, 4]
            bins = pd.qcut(grp["x"], 4, labels=labels)
        except ValueError:  # repeated edges: pandas raises
            continue
        for i, b in zip(grp["id"], bins):
            out[(g, i)] = int(b)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("method", ["count", "sort"])
def test_qcut_value_matches_pandas(spark, seed, method):
    data = _series(seed)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["g"], r["id"]): r["b"] for r in
           qcut_value(df, ["g"], "x", "b", method=method).collect()}
    want = _pandas_qcut(data)
    assert want, "some groups must have unique edges"
    for k, v in want.items():
        assert got[k] == v, k


def test_qcut_value_reverse(spark):
    data = _series(7)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["g"], r["id"]): r["b"] for r in qcut_value(df, ["g"], "x", "b", reverse=True).collect()}
    for k, v in _pandas_qcut(data, reverse=True).items():
        assert got[k] == v


def test_qcut_value_duplicates(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (1, 4, 2.0), (2, 1, 7.0)], SCHEMA)
    skip = {(r["g"], r["id"]): r["b"] for r in qcut_value(df, ["g"], "x", "b").collect()}
    # edges 1,1,1,1.25,2: value 1 -> bin 1, value 2 -> bin 4; a single value -> bin 1
    assert skip == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 4, (2, 1): 1}
    with pytest.raises(Exception, match="not unique"):
        qcut_value(df, ["g"], "x", "b", duplicates="raise").collect()


def test_qcut_rank_matches_pandas_first_rank(spark):
    rnd = random.Random(5)
    data = [(g, i, float(rnd.randint(1, 4))) for g in range(2, 40) for i in range(g)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["g"], r["id"]): r["b"] for r in
           qcut_rank(df, ["g"], [F.col("x"), F.col("id")], "b").collect()}
    pdf = pd.DataFrame(data, columns=["g", "id", "x"]).sort_values(["g", "id"])
    for g, grp in pdf.groupby("g"):
        bins = pd.qcut(grp["x"].rank(method="first"), 4, labels=[1, 2, 3, 4])
        for i, b in zip(grp["id"], bins):
            assert got[(g, i)] == int(b), (g, i)


def test_qcut_rank_is_not_ntile(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], SCHEMA)
    got = [r["b"] for r in qcut_rank(df, ["g"], [F.col("x")], "b").orderBy("x").collect()]
    # edges of ranks 1..6 are 1, 2.25, 3.5, 4.75, 6; ntile(4) would give 1,1,2,2,3,4
    assert got == [1, 1, 2, 3, 4, 4]
    one = spark.createDataFrame([(1, 1, 5.0)], SCHEMA)
    assert [r["b"] for r in qcut_rank(one, ["g"], [F.col("x")], "b").collect()] == [1]


def _ranked_by_hand(data):
    out = {}
    for g in {r[0] for r in data}:
        order = sorted((x, i) for gg, i, x in data if gg == g)
        out |= {(g, i): (k + 1, len(order)) for k, (_, i) in enumerate(order)}
    return out


def test_ranks_of_hot_and_small_groups(spark):
    rnd = random.Random(11)
    # one hot group with most rows, several small ones
    data = [(0, i, float(rnd.randint(0, 50))) for i in range(3000)]
    data += [(g, i, float(rnd.randint(0, 50))) for g in range(1, 5) for i in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    ranked = [group_rank(df, ["g"], [F.col("x"), F.col("id")]),
              class_rank(range_tagged(df, [F.col("g"), F.col("id")]), ["g"], "x", "id")]
    for r in ranked:
        assert {(r["g"], r["id"]): (r["rank"], r["group_size"]) for r in r.collect()} == _ranked_by_hand(data)


def test_sort_rank_reads_checkpoint(spark):
    """The sort path ranks from a checkpointed, range-sorted frame; the only
    window runs over the small (group, partition) span table."""
    df = spark.createDataFrame([(0, i, float(i % 13)) for i in range(500)], SCHEMA)
    plan = group_rank(df, ["g"], [F.col("x"), F.col("id")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in text and "Join" in text
    assert sorted(r["rank"] for r in plan.collect()) == list(range(1, 501))


def test_quantile_edges_methods_agree(spark):
    data = _series(21)
    df = spark.createDataFrame(data, SCHEMA)
    res = {}
    for m in ("count", "sort"):
        res[m] = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                        for r in quantile_edges(df, ["g"], "x", method=m).collect())
    assert res["count"] == res["sort"]
    pdf = pd.DataFrame(data, columns=["g", "id", "x"])
    q = pdf.groupby("g")["x"].quantile([0, .25, .5, .75, 1]).unstack()
    for r in res["count"]:
        assert np.allclose(r[1:], q.loc[r[0]].values)


def test_lower_median(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 40.0), (1, 3, 20.0), (1, 4, 30.0),
                                (2, 1, 1.0), (2, 2, 2.0), (2, 3, 3.0), (2, 4, 4.0), (2, 5, 5.0)], SCHEMA)
    got = dict((r["g"], r["median"]) for r in lower_median(df, ["g"], "x").collect())
    assert got == {1: 20.0, 2: 3.0}  # N=4 -> 2nd value, N=5 -> 3rd


def test_boxplot_matches_describe(spark):
    rnd = random.Random(3)
    data = [(g, i, float(rnd.randint(2, 9))) for g in range(5) for i in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["g"]: r for r in boxplot_stats(df, ["g"], "x").collect()}
    pdf = pd.DataFrame(data, columns=["g", "id", "x"])
    for g, grp in pdf.groupby("g"):
        d = grp["x"].describe()
        iqr = d["75%"] - d["25%"]
        want = [d["min"], max(d["min"], d["25%"] - 1.5 * iqr), d["25%"], d["50%"], d["75%"],
                min(d["max"], d["75%"] + 1.5 * iqr), d["max"], iqr]
        r = got[g]
        have = [r[c] for c in ("min", "lower_whisker", "q1", "median", "q3", "upper_whisker", "max", "iqr")]
        assert np.allclose(have, want)


def test_top_k_ties_and_plan(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 5, 5, 3, 1])], SCHEMA)
    res = top_k(df, ["g"], [F.desc("x"), F.asc("id")], 2)
    assert sorted(rows(res, "id")) == [(0,), (1,)]
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_densify_interior_only(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 4, 1.0), (2, 2, 2.0)], "g int, k int, v double")
    out = densify(df, ["g"], "k", F.sequence(F.min("k"), F.max("k")), {"v": 0.0})
    assert sorted(rows(out, "g", "k", "v")) == [(1, 1, 3.0), (1, 2, 0.0), (1, 3, 0.0), (1, 4, 1.0), (2, 2, 2.0)]


def test_pct_change(spark):
    df = spark.createDataFrame([(100.0, 150.0), (0.0, 5.0), (None, 5.0)], "a double, b double")
    got = [r[0] for r in df.select(pct_change(F.col("a"), F.col("b"))).collect()]
    assert got == [50.0, None, None]


def test_fits_broadcast(spark):
    small = spark.range(100).withColumn("s", F.lit("abc"))
    assert fits_broadcast(small)
    assert not fits_broadcast(small, max_bytes=100)
    joined = join_dim(spark.range(10).withColumnRenamed("id", "k"), small.withColumnRenamed("id", "k"), "k")
    assert "Broadcast" in joined._jdf.queryExecution().executedPlan().toString()


def test_dates_and_text(spark):
    from datetime import datetime
    df = spark.createDataFrame([(datetime(2021, 1, 1, 3, 0), datetime(2020, 12, 30, 18, 0),
                                 datetime(2021, 1, 1, 12, 0))],
                               "t timestamp_ntz, a timestamp_ntz, b timestamp_ntz")
    r = df.select(local_hour("t").alias("h"), F.year("t").alias("y"), whole_days("a", "b").alias("d"),
                  F.datediff(F.col("b"), F.col("a")).alias("dd")).first()
    assert (r["h"], r["y"], r["d"], r["dd"]) == (19, 2021, 1, 2)  # H8, H4
    txt = spark.createDataFrame([(1234.5, 1250.0, 999.5, 2500000.0, None)], "a double, b double, c double, "
                                "d double, e double")
    r = txt.select(money_text("a").alias("m"), short_money("a").alias("s1"), short_money("b").alias("s2"),
                   short_money("c").alias("s3"), short_money("d").alias("s4"), percent_text("e").alias("p"),
                   percent_text("b").alias("p2")).first()
    assert r["m"] == "$1,234.50"
    assert (r["s1"], r["s2"], r["s3"], r["s4"]) == (f"{1.2345:.1f}k", f"{1.25:.1f}k", "999.5", "2.5m")
    assert (r["p"], r["p2"]) == ("n/a", "1250.00%")
    days = spark.createDataFrame([(i,) for i in range(7)], "d int").select(weekday_name("d").alias("n"))
    assert [x["n"] for x in days.collect()][0::6] == ["Monday", "Sunday"]


def test_in_years_reaches_parquet(spark):
    from shop_fixtures import SF
    o = spark.read.parquet(f"{SF}/orders.parquet").where(in_years("o_orderdate", [1996, 1997, 1999]))
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    n = o.count()
    m = spark.read.parquet(f"{SF}/orders.parquet").where(F.year("o_orderdate").isin(1996, 1997, 1999)).count()
    assert n == m > 0


def test_rank_bin_equals_pandas_for_every_size(spark):
    from storelens.operators.quantiles import rank_bin
    pairs = [(n, r) for n in range(1, 201) for r in range(1, n + 1)]
    df = spark.createDataFrame(pairs, "n long, r long")
    got = {(x["n"], x["r"]): x["b"] for x in df.select("n", "r", rank_bin("r", "n", 4).alias("b")).collect()}
    for n in range(2, 201):
        bins = pd.qcut(pd.Series(range(1, n + 1), dtype=float), 4, labels=[1, 2, 3, 4])
        for r, b in zip(range(1, n + 1), bins):
            assert got[(n, r)] == int(b), (n, r)
    assert got[(1, 1)] == 1


def test_in_years_equals_year_membership_for_any_set(spark):
    from datetime import datetime

    from hypothesis import given, settings
    from hypothesis import strategies as st

    stamps = [datetime(y, m, d, h) for y in range(1994, 2003) for (m, d, h) in ((1, 1, 0), (6, 15, 12), (12, 31, 23))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, ts timestamp_ntz").cache()

    @settings(max_examples=25, deadline=None)
    @given(st.sets(st.integers(min_value=1993, max_value=2004), max_size=6))
    def check(years):
        got = {r["i"] for r in df.where(in_years("ts", years)).collect()}
        want = {i for i, s in enumerate(stamps) if s.year in years}
        assert got == want

    check()
