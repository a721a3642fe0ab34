"""Incremental refresh of the customer reports: first orders, repeat customers, RFM.

These reports are not sums of their batches: a customer becomes a repeat customer
with one order of a later batch, and an earlier order that arrives late moves the
year of a first order. So the customers' running figures live in the state of a
streaming query (``applyInPandasWithState``), and a batch reports only what it
changed:

* a customer whose first order moves: -1 for the old year, +1 for the new one;
* a (store, customer, year) whose number of orders passes one: +1;
* the new figures (orders with items, last order, value) of each (store, customer,
  year) that the batch has orders of.

Changes are added to small tables per year and per (store, year), and appended to
the table of customer values, which is compacted when the changes since the last
compaction outnumber it. RFM is scored again for the stores that the batch touched,
from the customer values alone; orders and items are not read again.

Before the state's shuffle every task adds up its orders per (store, customer, year),
so a customer with a third of all orders sends a row per task and Arrow batch.

Every folder is named after its batch and written whole, so a batch that is repeated
after a failure replaces what its first try left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from storelens.plans.common import check_mode, known_stores, order_value, with_item_sums
from storelens.plans.customers import score_values, segment_scores
from storelens.sources.sinks import file_system, write_report
from storelens.sources.tables import ShopTables
from storelens.streaming.refresh import REFRESH_EVERY, _default_checkpoint

_MONEY = "decimal(38,4)"
_PART = "s string, c string, y int, n long, first timestamp_ntz, vn long, vlast timestamp_ntz, vsum " + _MONEY


def valued_orders(t: ShopTables, mode: str = "reference") -> DataFrame:
    """Orders with ``value``, their item value (null without items of known products): what the refresh reads."""
    check_mode(mode)
    value = F.when(F.col("item_rows") > 0, F.coalesce(order_value(mode), F.lit(0)))
    return (with_item_sums(t, t.orders, "left")
            .select(*t.orders.columns, value.cast(_MONEY).alias("value")))


def _key(c: str):
    """A key as text; nulls are a key of their own."""
    return F.coalesce(F.concat(F.lit("k"), F.col(c).cast("string")), F.lit("n"))


def _added_up(orders: DataFrame) -> DataFrame:
    """Each task's orders per (store, customer, year): partial sums, before any shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = pa.Table.from_batches([b]).group_by(["s", "c", "y"]).aggregate(
                [("n", "sum"), ("first", "min"), ("vn", "sum"), ("vlast", "max"), ("vsum", "sum")])
            names = ["s", "c", "y", "n", "first", "vn", "vlast", "vsum"]
            cols = [g["s"], g["c"], g["y"], g["n_sum"], g["first_min"], g["vn_sum"], g["vlast_max"],
                    g["vsum_sum"].cast(pa.decimal128(38, 4))]
            yield from pa.Table.from_arrays(cols, names).to_batches()

    valued = F.col("value").isNotNull()
    return orders.select(
        _key("storeid").alias("s"), _key("customerid").alias("c"), F.year("orderdate").alias("y"),
        F.col("orderid").isNotNull().cast("long").alias("n"), F.col("orderdate").alias("first"),
        (valued & F.col("orderid").isNotNull()).cast("long").alias("vn"), F.when(valued, F.col("orderdate")).alias("vlast"),
        F.coalesce(F.col("value"), F.lit(0)).cast(_MONEY).alias("vsum")).mapInArrow(run, _PART)


def _first_orders(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of a customer's first year."""
    old = state.get[0] if state.exists else None
    new = min([p["first"].min() for p in parts] + ([] if old is None else [old]))
    if pd.isna(new):
        return
    state.update((pd.Timestamp(new).to_pydatetime(),))
    if old is None or pd.Timestamp(old).year != pd.Timestamp(new).year:
        rows = [(pd.Timestamp(new).year, 1)] + ([] if old is None else [(pd.Timestamp(old).year, -1)])
        yield pd.DataFrame(rows, columns=["year", "delta"])


def _figures(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New figures of a customer at a store in a year, and whether the batch made it a repeat customer."""
    n, vn, last, value = state.get if state.exists else (0, 0, None, None)
    before = n
    for p in parts:
        n += int(p["n"].sum())
        vn += int(p["vn"].sum())
        seen = p["vlast"].max()
        if not pd.isna(seen):
            last = seen.to_pydatetime() if last is None else max(pd.Timestamp(last), seen).to_pydatetime()
        value = sum(p["vsum"], value or 0)
    state.update((n, vn, last, value))
    yield pd.DataFrame({"s": [key[0]], "c": [key[1]], "y": [key[2]], "repeat": [int(before <= 1 < n)], "frequency": [vn],
                        "last_order": [last], "monetary": [value]})


class CustomerFigures:
    """The kept tables under ``root``: sums per year and per (store, year), and the customers' values."""

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, str]):
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), kinds

    def _ids(self, name: str) -> list[int]:
        fs, hadoop = file_system(self.spark, self.root)
        folder = hadoop(f"{self.root}/{name}")
        found = [f.getPath() for f in (fs.listStatus(folder) if fs.exists(folder) else [])]
        return sorted(int(p.getName()) for p in found if fs.exists(hadoop(f"{self.root}/{name}/{p.getName()}/_SUCCESS")))

    def _drop(self, name: str, ids: list[int]) -> None:
        fs, hadoop = file_system(self.spark, self.root)
        for k in ids:
            fs.delete(hadoop(f"{self.root}/{name}/{k}"), True)

    def add(self, name: str, changes: DataFrame, keys: list[str], batch_id: int) -> None:
        """Table ``name`` of the batch before plus the changes, as ``{name}/{batch_id}``; the last two are kept."""
        known = [k for k in self._ids(name) if k < batch_id]
        if known:
            changes = changes.unionByName(self.spark.read.parquet(f"{self.root}/{name}/{known[-1]}"))
        (changes.groupBy(*keys).agg(F.sum("n").alias("n")).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/{name}/{batch_id}"))
        self._drop(name, known[:-1])

    def sums(self, name: str) -> DataFrame | None:
        known = self._ids(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{known[-1]}") if known else None

    def _key(self, name: str, at: str):
        return F.expr(f"if({at} = 'n', null, substring({at}, 2))").cast(self.kinds[name]).alias(name)

    def values(self, upto: int | None = None) -> DataFrame | None:
        """The latest figures per (store, customer, year): the compacted table and the changes since."""
        base, changes = self._ids("_values"), self._ids("_changes")
        since = base[-1] if base else -1
        parts = [f"{self.root}/_values/{since}"] if base else []
        parts += [f"{self.root}/_changes/{k}" for k in changes if k > since and (upto is None or k <= upto)]
        if not parts:
            return None
        rows = self.spark.read.parquet(*parts)
        latest = F.max(F.struct("batch", "frequency", "last_order", "monetary")).alias("v")
        return rows.groupBy("s", "c", "y").agg(latest).select("s", "c", "y", "v.*")

    def compact(self, batch_id: int) -> bool:
        """Merge the changes into one table once they outnumber it: each row is rewritten a bounded number of times."""
        base, changes = self._ids("_values"), self._ids("_changes")
        since = base[-1] if base else -1
        newer = [k for k in changes if since < k <= batch_id]
        if not newer:
            return False
        count = lambda paths: self.spark.read.parquet(*paths).count() if paths else 0  # noqa: E731  from the footers
        if count([f"{self.root}/_changes/{k}" for k in newer]) < count([f"{self.root}/_values/{since}"] if base else []):
            return False
        self.values(batch_id).write.mode("overwrite").parquet(f"{self.root}/_values/{batch_id}")
        self._drop("_values", base[:-1])
        self._drop("_changes", [k for k in changes if k < newer[0]])  # those of the table before stay for a repeated batch
        return True

    def customer_values(self, year: int, stores: DataFrame | None = None) -> DataFrame:
        """The table that RFM scores: storeid, customerid, last_order, frequency, monetary of one year."""
        rows = self.values().where((F.col("y") == int(year)) & F.col("last_order").isNotNull())
        if stores is not None:
            rows = rows.join(stores, "s", "left_semi")
        return rows.select(self._key("storeid", "s"), self._key("customerid", "c"), "last_order", "frequency", "monetary")


def refresh_customers(spark: SparkSession, orders_dir: str, tables: Callable[[DataFrame], ShopTables], out_root: str,
                      rfm_year: int | None = None, checkpoint_location: str | None = None, every: str = REFRESH_EVERY,
                      available_now: bool = False, orders_format: str = "parquet", schema: StructType | None = None,
                      max_files: int | None = None) -> list[StreamingQuery]:
    """Start the streaming queries that keep the customer reports under ``out_root`` fresh.

    ``orders_dir`` grows by files of :func:`valued_orders`. Kept reports:
    ``new_customers`` (first_year, new_customers), ``repeat_customers`` (as the
    report) and, with ``rfm_year``, ``rfm_scores`` and ``rfm_segments`` of that year,
    partitioned by store. ``max_files``: files a batch takes at most. Other
    parameters as in :func:`storelens.streaming.refresh_reports`.
    """
    schema = schema or spark.read.format(orders_format).load(orders_dir).schema
    root = out_root.rstrip("/")
    kinds = {c: schema[c].dataType.simpleString() for c in ("storeid", "customerid")}
    kept = CustomerFigures(spark, f"{root}/_state", kinds)

    def orders() -> DataFrame:
        reader = spark.readStream.format(orders_format).schema(schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return _added_up(reader.load(orders_dir))

    def first_years(batch: DataFrame, batch_id: int) -> None:
        kept.add("_first", batch.select("year", F.col("delta").cast("long").alias("n")), ["year"], batch_id)
        sums = kept.sums("_first").where("n <> 0")
        write_report(sums.select(F.col("year").alias("first_year"), F.col("n").alias("new_customers")), f"{root}/new_customers")

    def customer_years(batch: DataFrame, batch_id: int) -> None:
        path = f"{kept.root}/_changes/{batch_id}"
        batch.withColumn("batch", F.lit(int(batch_id)).cast("long")).write.mode("overwrite").parquet(path)
        changes = spark.read.parquet(path)
        kept.add("_repeat", changes.where("c <> 'n'").select("s", "y", F.col("repeat").cast("long").alias("n")),
                 ["s", "y"], batch_id)
        t = tables(spark.createDataFrame([], schema))
        counts = kept.sums("_repeat").where("n > 0").select(
            kept._key("storeid", "s"), F.col("y").alias("year"), F.col("n").alias("repeat_customers"))
        write_report(counts.join(t.stores.select("storeid", "city"), "storeid")
                     .select("storeid", "city", "year", "repeat_customers"), f"{root}/repeat_customers")
        if rfm_year is not None:
            touched = changes.where((F.col("y") == rfm_year) & F.col("last_order").isNotNull()).select("s").distinct()
            values = known_stores(t, kept.customer_values(rfm_year, touched))
            scores = score_values(values)
            for name, df in (("rfm_scores", scores), ("rfm_segments", segment_scores(scores))):
                (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("storeid")
                 .parquet(f"{root}/{name}"))
        kept.compact(batch_id)

    where = checkpoint_location or _default_checkpoint(spark, "customers", out_root)

    def start(rows: DataFrame, write: Callable, name: str) -> StreamingQuery:
        w = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/{name}").outputMode("append")
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()

    first = orders().where("c <> 'n'").groupBy("c").applyInPandasWithState(
        _first_orders, "year int, delta int", "first timestamp_ntz", "append", GroupStateTimeout.NoTimeout)
    figures = orders().groupBy("s", "c", "y").applyInPandasWithState(
        _figures, f"s string, c string, y int, repeat int, frequency long, last_order timestamp_ntz, monetary {_MONEY}",
        f"n long, vn long, last timestamp_ntz, value {_MONEY}", "append", GroupStateTimeout.NoTimeout)
    return [start(first, first_years, "first"), start(figures, customer_years, "figures")]
