"""Exact selection by radix digits and by bracketed quantiles, against numpy and Spark's own aggregates."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators.quantiles import boxplot_stats, lower_median, qcut_value, quantile_edges
from storelens.operators.selection import bracketed_quantiles, select_ranks
from storelens.session import plan_text


def test_radix_equals_percentile_disc(spark):
    """A million distinct decimals, negative ones and a heavy value included."""
    df = spark.range(1_000_000).select(
        (F.col("id") % 3).alias("g"),
        ((F.xxhash64("id") % 10_000_000_000) / 100).cast("decimal(12,2)").alias("x"))
    df = df.unionByName(spark.range(400_000).select(F.lit(1).cast("long").alias("g"), F.lit(Decimal("7.25")).cast("decimal(12,2)").alias("x")))
    got = {r.g: r for r in select_ranks(df, ["g"], "x", {"m": F.expr("(size + 1) div 2"), "least": F.lit(1), "most": F.col("size")}).collect()}
    want = df.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("m"), F.min("x").alias("least"),
                               F.max("x").alias("most")).collect()
    assert len(want) == 3
    for w in want:
        assert (float(got[w.g].m), got[w.g].least, got[w.g].most) == (w.m, w.least, w.most)
    one = lower_median(df, [], "x", method="radix").first().median
    assert float(one) == df.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)")).first()[0]


def test_radix_holds_no_value_map(spark):
    df = spark.range(5000).select(F.col("id").cast("decimal(12,2)").alias("x"))
    plan = plan_text(lower_median(df, [], "x", method="radix"))
    assert "percentile" not in plan.lower() and "collect" not in plan.lower()
    # the rows of a pass meet only as counts per digit
    assert plan.count("keys [2]: [_p") >= 1 or "_d" in plan


@pytest.mark.parametrize("kind, values", [
    ("int", [5, 1, 1, 9, 7]), ("bigint", [-(1 << 40), 3, 1 << 40, 3]), ("decimal(22,4)", [Decimal("0.0001"), Decimal("-3.5"), Decimal("12345678.9")]),
    ("decimal(12,2)", [Decimal("1.10")]), ("int", [None, 4, None])])
def test_radix_small(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    have = sorted(v for v in values if v is not None)
    assert lower_median(df, [], "x", method="radix").first().median == have[(len(have) - 1) // 2]


def test_radix_edges(spark):
    none = spark.createDataFrame([], "g string, x int")
    assert select_ranks(none, ["g"], "x", {"m": F.lit(1)}).count() == 0
    assert [r.median for r in lower_median(none, [], "x", method="radix").collect()] == [None]
    some = spark.createDataFrame([(None, 3), (None, 1), ("a", None)], "g string, x int")
    assert [tuple(r) for r in select_ranks(some, ["g"], "x", {"m": F.lit(1)}).collect()] == [(None, 1)]
    wide = spark.createDataFrame([(Decimal(-10**20),), (Decimal(10**20),)], "x decimal(38,0)")
    with pytest.raises(ValueError, match="62 bits"):
        lower_median(wide, [], "x", method="radix")
    with pytest.raises(ValueError, match="decimals"):
        select_ranks(spark.createDataFrame([(1.5,)], "x double"), [], "x", {"m": F.lit(1)})


def _table(spark, parts):
    rows = [(g, float(v)) for g, values in parts.items() for v in values]
    return spark.createDataFrame(rows, "g string, x double").repartition(7)


def test_brackets_equal_numpy(spark):
    rng = np.random.default_rng(1)
    fractions = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    parts = {"normal": rng.standard_normal(60_000), "one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 500,
             "heavy": np.concatenate([np.full(20_000, 5.0), rng.random(25_000) * 10]), "log": np.exp(rng.standard_normal(30_000) * 5)}
    got = {r.g: r._q for r in bracketed_quantiles(_table(spark, parts), ["g"], "x", fractions).collect()}
    for g, values in parts.items():
        assert np.allclose(got[g], np.quantile(values, fractions), rtol=1e-12), g
    # a coarse sketch brackets more rows and finds the same values
    coarse = {r.g: r._q for r in bracketed_quantiles(_table(spark, parts), ["g"], "x", fractions, accuracy=50).collect()}
    assert coarse == got


def test_brackets_count_most_rows_only(spark):
    df = spark.range(400_000).select(F.lit("a").alias("g"), (F.rand(3) * 1000).alias("x"))
    q = bracketed_quantiles(df, ["g"], "x", [0.5])
    plan = plan_text(q)
    assert "rangepartitioning" not in plan
    x = np.array([r.x for r in df.select("x").collect()])
    assert q.first()._q[0] == np.quantile(x, 0.5)


def test_brackets_null_groups_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "g string, x double")
    got = {r.g: r._q for r in bracketed_quantiles(df, ["g"], "x", [0.5]).collect()}
    assert got == {None: [2.0], "b": [2.0]}
    assert bracketed_quantiles(df, [], "x", [0.5]).first()._q == [2.0]
    assert bracketed_quantiles(df.where("false"), [], "x", [0.5]).count() == 0


def test_edges_bins_and_boxplots_by_brackets(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(g), int(k), Decimal(int(v)) / 100) for k, (g, v) in enumerate(zip(
        rng.integers(0, 4, 3000), rng.integers(1, 100_000, 3000), strict=True))], "g int, k int, x decimal(12,2)")
    a = sorted(map(tuple, quantile_edges(df, ["g"], "x", method="bracket").collect()))
    b = sorted(map(tuple, quantile_edges(df, ["g"], "x", method="sort", tie=["k"]).collect()))
    assert a == b
    bins = lambda m, **kw: sorted(map(tuple, qcut_value(df, ["g"], "x", "b", method=m, **kw).select("g", "k", "b").collect()))
    assert bins("bracket") == bins("sort", tie=["k"])
    box = lambda m: sorted(map(tuple, boxplot_stats(df, ["g"], "x", method=m).collect()))
    assert np.allclose(box("bracket"), box("count"), rtol=1e-12)
