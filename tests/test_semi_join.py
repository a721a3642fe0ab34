"""Semi join with a large dimension: rows are dropped below the shuffle, the result is that of the plain join."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from shop_fixtures import SF

from storelens.operators import BLOOM_SETTINGS, semi_join
from storelens.plans import products
from storelens.session import plan_text
from storelens.sources import tables_from_tpch


@pytest.fixture()
def large_tables(spark):
    """Settings under which test tables count as large."""
    conf = BLOOM_SETTINGS | {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b"}
    saved = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bloom_filter_below_the_shuffle(spark, tmp_path, large_tables):
    fact = spark.range(200_000).select((F.col("id") % 50_000 * 7).alias("customerid"), F.col("id").alias("orderid"))
    fact.write.parquet(f"{tmp_path}/fact")
    spark.range(300).select((F.col("id") * 1000).alias("customerid"), F.lit(1.0).alias("latitude")).write.parquet(f"{tmp_path}/dim")
    fact, dim = spark.read.parquet(f"{tmp_path}/fact"), spark.read.parquet(f"{tmp_path}/dim")
    joined = semi_join(fact, dim, "customerid", small=False)
    want = fact.join(dim, "customerid", "left_semi")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    plan = plan_text(joined)
    assert "might_contain" in plan and "PushedFilters" in plan and "LessThanOrEqual(customerid,299000)" in plan
    # the filter stands between the fact's scan and its exchange
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") >= 2 and "Subquery" in plan


def test_report_through_the_semi_join(spark, large_tables):
    t = tables_from_tpch(spark, SF)
    some = t.customers.where("customerid % 3 = 0")
    bundle = replace(t, customers=some, _small={"customers": False, "stores": True, "products": True})
    got = sorted(map(tuple, products.customer_product_counts(bundle).collect()))
    plain = sorted(map(tuple, products.customer_product_counts(t).where("customerid % 3 = 0").collect()))
    assert got == plain and got


@pytest.mark.parametrize("keys", [[], [None], [5], ["a", "zz"]])
def test_edges(spark, keys):
    kind = "string" if keys and isinstance(keys[0], str) else "long"
    dim = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    fact = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)] if kind == "string" else [(5, 1), (6, 2), (None, 3)], f"k {kind}, v int")
    want = sorted(map(str, fact.join(dim, "k", "left_semi").collect()))
    for small in (True, False, None):
        assert sorted(map(str, semi_join(fact, dim, "k", small).collect())) == want
