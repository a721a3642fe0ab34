"""Keep materialised reports fresh as new order files arrive.

The dashboard answered from a cache that expired every 300 seconds. Here the
same freshness is a Structured Streaming query over the orders folder. Spark's
file source tracks which files were seen in the checkpoint location, so a
restarted job resumes where it stopped.

* ``refresh_sales`` keeps sums per store and month: a micro-batch adds the sums
  of its own orders, and the reports read the sums. The work of a batch grows
  with the batch, not with the table. For reports that need nothing but totals
  by store and month (:data:`SALES_REPORTS`).
* ``refresh_reports`` rebuilds any reports from the whole orders table; for
  tables small enough to be read on every trigger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pyspark.sql import functions as F

from storelens.plans import sales
from storelens.session import ensure_checkpoint_dir
from storelens.sources.sinks import file_system, write_report
from storelens.sources.tables import ShopTables

# Fixed value: the lifetime of a cached answer.
REFRESH_EVERY = "300 seconds"

#: Reports whose orders may be replaced by sums per store and month.
SALES_REPORTS = ("top_stores", "worst_stores", "store_annual_revenues", "kpi_total_revenue",
                 "kpi_avg_revenue_per_store", "kpi_revenue_per_year", "kpi_avg_store_revenue_per_year",
                 "store_monthly_revenue", "store_monthly_revenue_map", "store_monthly_filled", "sales_map", "stores_table")


def _default_checkpoint(spark: SparkSession, kind: str, out_root: str) -> str:
    """A folder of its own for every full target path."""
    tag = hashlib.sha256(out_root.rstrip("/").encode()).hexdigest()[:24]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{tag}"


def month_sums(orders: DataFrame) -> DataFrame:
    """Orders as one row per store and month with their summed total, in the columns of orders."""
    month = F.date_trunc("month", F.col("orderdate")).cast("timestamp_ntz")
    sums = orders.groupBy("storeid", month.alias("orderdate")).agg(F.sum("total").alias("total"))
    kinds = dict(orders.dtypes)
    return sums.select("storeid", "orderdate", "total",
                       *[F.lit(None).cast(kinds[c]).alias(c) for c in ("orderid", "customerid", "nitems")])


def refresh_sales(spark: SparkSession, orders_dir: str, tables: Callable[[DataFrame], ShopTables], out_root: str,
                  reports: dict[str, dict] | None = None, checkpoint_location: str | None = None,
                  every: str = REFRESH_EVERY, available_now: bool = False, orders_format: str = "parquet",
                  schema: StructType | None = None) -> StreamingQuery:
    """Start a streaming query that keeps ``{out_root}/{report}`` of the sales reports fresh, incrementally.

    ``reports`` maps names of :data:`SALES_REPORTS` to their parameters. A batch
    adds its sums to those up to the batch before it and writes them to
    ``{out_root}/_sums/<id>``; a batch repeated after a failure starts from the
    same folder, so no order counts twice. The last two folders are kept: one
    row per store and month each. Other parameters as in :func:`refresh_reports`.
    """
    reports = reports or {name: {} for name in SALES_REPORTS}
    if set(reports) - set(SALES_REPORTS):
        raise ValueError(f"not made of monthly sums: {sorted(set(reports) - set(SALES_REPORTS))}")
    schema = schema or spark.read.format(orders_format).load(orders_dir).schema
    stream = spark.readStream.format(orders_format).schema(schema).load(orders_dir)
    root = out_root.rstrip("/")

    def add(batch: DataFrame, batch_id: int) -> None:
        sums = month_sums(batch)
        fs, hadoop = file_system(spark, root)
        folder = hadoop(f"{root}/_sums")
        known = [int(f.getPath().getName()) for f in (fs.listStatus(folder) if fs.exists(folder) else [])]
        before = max((k for k in known if k < batch_id), default=None)
        if before is not None:
            sums = month_sums(sums.unionByName(spark.read.parquet(f"{root}/_sums/{before}")))
        sums.write.mode("overwrite").parquet(f"{root}/_sums/{batch_id}")
        for k in known:
            if before is not None and k < before:
                fs.delete(hadoop(f"{root}/_sums/{k}"), True)
        bundle = tables(spark.read.parquet(f"{root}/_sums/{batch_id}"))
        for name, params in reports.items():
            write_report(getattr(sales, name)(bundle, **params), f"{root}/{name}")

    where = checkpoint_location or _default_checkpoint(spark, "sales", out_root)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", where)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def refresh_reports(spark: SparkSession, orders_dir: str, tables: Callable[[DataFrame], ShopTables],
                    reports: dict[str, Callable[[ShopTables], DataFrame]], out_root: str,
                    checkpoint_location: str | None = None, every: str = REFRESH_EVERY,
                    available_now: bool = False, orders_format: str = "parquet",
                    schema: StructType | None = None) -> StreamingQuery:
    """Start a streaming query that rewrites ``{out_root}/{name}`` for every report.

    ``tables(orders)`` builds the bundle from the current orders (the other
    four tables change rarely and are read as they are). ``every`` is the
    trigger interval; ``available_now=True`` processes the files present and
    stops (a catch-up run). The checkpoint location defaults to a folder
    under the session's ``spark.checkpoint.dir``. ``schema`` is the orders
    schema; without it the files already in ``orders_dir`` give it.
    """
    schema = schema or spark.read.format(orders_format).load(orders_dir).schema
    stream = spark.readStream.format(orders_format).schema(schema).load(orders_dir)
    if checkpoint_location is None:
        checkpoint_location = _default_checkpoint(spark, "refresh", out_root)

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        orders = spark.read.format(orders_format).schema(schema).load(orders_dir)
        bundle = tables(orders)
        for name, report in reports.items():
            write_report(report(bundle), f"{out_root.rstrip('/')}/{name}")

    writer = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
