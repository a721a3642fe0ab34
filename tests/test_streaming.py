"""Materialised reports refreshed by a streaming query over a growing orders folder."""

from __future__ import annotations

import os
import tempfile

from shop_fixtures import SF
from pyspark.sql import functions as F

from storelens.plans import sales
from storelens.sources import read_report, tables_from_tpch
from storelens.streaming import refresh_reports


def test_refresh_reports_follows_new_files(spark):
    root = tempfile.mkdtemp(prefix="storelens-stream-", dir=os.environ.get("TMPDIR", "/tmp"))
    t = tables_from_tpch(spark, SF)
    orders = t.orders
    early = orders.where(F.col("orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = orders.where(F.col("orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    early.write.mode("append").parquet(f"{root}/orders")

    reports = {"top_stores": lambda b: sales.top_stores(b, [1996, 1997, 1998, 1999, 2000]),
               "revenue_per_year": lambda b: sales.kpi_revenue_per_year(b, [1996, 1997, 1998, 1999, 2000])}

    def run():
        q = refresh_reports(spark, f"{root}/orders", t.with_orders, reports, f"{root}/reports",
                            checkpoint_location=f"{root}/ckpt", available_now=True)
        q.awaitTermination(600)

    run()
    got = read_report(spark, f"{root}/reports/revenue_per_year")
    assert sorted(r["year"] for r in got.collect()) == [1996, 1997]

    late.write.mode("append").parquet(f"{root}/orders")
    run()  # resumes from the checkpoint: only the new files trigger a rebuild
    got = {r["year"]: r["total_revenue"] for r in read_report(spark, f"{root}/reports/revenue_per_year").collect()}
    want = {r["year"]: r["total_revenue"]
            for r in sales.kpi_revenue_per_year(t, [1996, 1997, 1998, 1999, 2000]).collect()}
    assert got == want
    top = read_report(spark, f"{root}/reports/top_stores")
    assert top.count() == 25


def test_refresh_sales_adds_each_batch_once(spark, tmp_path):
    from storelens.streaming import refresh_sales
    t = tables_from_tpch(spark, SF)
    day = F.datediff(F.col("orderdate").cast("date"), F.lit("1998-01-15").cast("date"))
    want = {"top_stores": sales.top_stores(t, [1997, 1998, 1999]), "kpi_total_revenue": sales.kpi_total_revenue(t),
            "store_monthly_revenue": sales.store_monthly_revenue(t), "sales_map": sales.sales_map(t, 1998)}
    params = {"top_stores": {"years": [1997, 1998, 1999]}, "kpi_total_revenue": {}, "store_monthly_revenue": {},
              "sales_map": {"year": 1998}}
    for part in (day < 0, (day >= 0) & (day < 400), (day >= 400) & (day < 500), day >= 500):
        t.orders.where(part).write.mode("append").parquet(f"{tmp_path}/orders")
        refresh_sales(spark, f"{tmp_path}/orders", t.with_orders, f"{tmp_path}/out", params,
                      checkpoint_location=f"{tmp_path}/ckpt", available_now=True).awaitTermination(600)
    assert len(os.listdir(f"{tmp_path}/out/_sums")) == 2
    for name, df in want.items():
        got = read_report(spark, f"{tmp_path}/out/{name}")
        assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(map(tuple, df.collect())), name
