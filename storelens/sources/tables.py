"""The five logical tables of a store chain, bundled for the reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.dates import in_years
from storelens.operators.joins import fits_broadcast, heavy_keys
from storelens.sources.sinks import file_system

# Column -> accepted Spark type classes. Keys may be any integral or string
# type; money must be exact decimal; the order time is wall time in UTC
# without a zone.
_KEY = (T.IntegerType, T.LongType, T.ShortType, T.StringType)
_NUM = (T.DoubleType, T.FloatType, T.DecimalType, T.IntegerType, T.LongType)
SCHEMA = {
    "stores": {"storeid": _KEY, "city": (T.StringType,), "latitude": _NUM, "longitude": _NUM},
    "customers": {"customerid": _KEY, "latitude": _NUM, "longitude": _NUM},
    "orders": {"orderid": _KEY, "customerid": _KEY, "storeid": _KEY,
               "orderdate": (T.TimestampNTZType,), "nitems": (T.IntegerType, T.LongType, T.ShortType),
               "total": (T.DecimalType,)},
    "orderitems": {"orderid": _KEY, "sku": _KEY},
    "products": {"sku": _KEY, "name": (T.StringType,), "category": (T.StringType,),
                 "size": _KEY, "price": (T.DecimalType,)},
}
TABLES = tuple(SCHEMA)
#: partition column of the monthly layout: year * 100 + month of ``orderdate`` (null: no date)
MONTH = "order_month"
KEYS = {"stores": "storeid", "customers": "customerid", "orders": "orderid", "products": "sku"}
# Column types for formats that carry none.
TEXT_TYPES = {
    "stores": {"storeid": "string", "city": "string", "latitude": "double", "longitude": "double"},
    "customers": {"customerid": "string", "latitude": "double", "longitude": "double"},
    "orders": {"orderid": "bigint", "customerid": "string", "storeid": "string", "orderdate": "timestamp_ntz",
               "nitems": "int", "total": "decimal(12,2)"},
    "orderitems": {"orderid": "bigint", "sku": "string"},
    "products": {"sku": "string", "name": "string", "category": "string", "size": "string", "price": "decimal(12,2)"},
}


@dataclass(frozen=True)
class ShopTables:
    """Lazy DataFrames of the five tables.

    Keys: ``stores.storeid``, ``customers.customerid`` and ``products.sku`` are
    unique; ``orders.orderid`` is, unless ``repeated`` holds ``"orders"``; one
    ``orderitems`` row is one item.
    """

    stores: DataFrame
    customers: DataFrame
    orders: DataFrame
    orderitems: DataFrame
    products: DataFrame
    #: names of tables whose key may repeat (re-delivered rows); reports then count distinct keys
    repeated: frozenset = frozenset()
    #: order ids that hold a large share of all order items (see :meth:`with_hot_orders`)
    hot_orders: tuple = ()
    _small: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession

    def is_small(self, name: str) -> bool:
        """True when table ``name`` provably fits the broadcast budget.

        Checked once per bundle (see
        :func:`storelens.operators.joins.fits_broadcast`); projections and
        filters of the table are smaller still, so the answer carries over.
        A bundle is a snapshot: make a new one (:meth:`with_orders` does)
        once the tables may have grown.
        """
        if name not in self._small:
            self._small[name] = fits_broadcast(getattr(self, name))
        return self._small[name]

    def with_orders(self, orders: DataFrame, repeated: bool | None = None) -> "ShopTables":
        """Same dimensions, other orders (e.g. a stream of timestamped events); ``repeated``: ids may occur again."""
        marked = self.repeated if repeated is None else frozenset({"orders"} if repeated else ())
        return replace(self, orders=orders, repeated=marked, _small={})

    def with_hot_orders(self, share: float = 0.01) -> "ShopTables":
        """The bundle with the orders that hold at least ``share`` of all items named, so that their items are added up apart."""
        return replace(self, hot_orders=tuple(heavy_keys(self.orderitems, "orderid", share)))

    def orders_in(self, years: Iterable[int]) -> DataFrame:
        """Orders of some years: ranges of ``orderdate``, and of the layout's partition column where there is one."""
        years = list(years)
        rows = self.orders.where(in_years("orderdate", years))
        if MONTH in self.orders.columns:
            rows = rows.where(reduce(Column.__or__, [F.col(MONTH).between(int(y) * 100 + 1, int(y) * 100 + 12) for y in years], F.lit(False)))
        return rows

    def check(self) -> "ShopTables":
        """Raise ``ValueError`` when a table misses a column or has a wrong type."""
        problems = []
        for name, cols in SCHEMA.items():
            fields = {f.name: f.dataType for f in getattr(self, name).schema.fields}
            for col, types in cols.items():
                if col not in fields:
                    problems.append(f"{name}.{col} missing")
                elif not isinstance(fields[col], types):
                    problems.append(f"{name}.{col} is {fields[col].simpleString()}")
        if problems:
            raise ValueError("table schema: " + "; ".join(problems))
        return self

    def check_keys(self) -> "ShopTables":
        """Raise ``ValueError`` when a key column repeats a value (one aggregate per table).

        Tables in ``repeated`` are exempt: the reports count their distinct keys.
        """
        problems = [f"{name}.{KEYS[name]} repeats {found}" for name, found in self._repeats().items()
                    if name not in self.repeated]
        if problems:
            raise ValueError("table keys: " + "; ".join(problems))
        return self

    def _repeats(self) -> dict[str, list]:
        """Up to three repeated keys of each table that has any."""
        out = {}
        for name, key in KEYS.items():
            again = getattr(self, name).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
            if found := [r[key] for r in again.select(key).limit(3).collect()]:
                out[name] = found
        return out

    def with_keys(self, keys: str = "check") -> "ShopTables":
        """The bundle with its keys settled as the readers' ``keys`` parameter says.

        * ``"check"``: the keys are checked; repeated order ids mark the orders as
          ``repeated`` (distinct ids are counted), repeated keys of another table
          raise ``ValueError``, since joins would multiply rows.
        * ``"trust"``: the source vouches for unique keys; nothing is read.
        * ``"repeated"``: orders may be delivered more than once; nothing is read.
        """
        if keys not in ("check", "trust", "repeated"):
            raise ValueError(f"keys must be 'check', 'trust' or 'repeated', not {keys!r}")
        if keys == "trust":
            return self
        if keys == "repeated":
            return replace(self, repeated=frozenset({"orders"}))
        found = self._repeats()
        marked = replace(self, repeated=frozenset({"orders"} & set(found)))
        if problems := [f"{name}.{KEYS[name]} repeats {keys}" for name, keys in found.items() if name != "orders"]:
            raise ValueError("table keys: " + "; ".join(problems))
        return marked


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet", types: dict | None = None,
                coerce: bool = False, keys: str = "check", **options) -> ShopTables:
    """Read ``{path}/{table}`` for the five tables in any Spark file format.

    Formats without types (JSON, CSV) are read with an explicit schema:
    ``TEXT_TYPES``, or per column ``types={"orders": {"orderid": "bigint"}}``.
    ``coerce=True`` reads such columns as text and casts them with
    ``try_cast``, so a value that does not parse becomes null instead of
    failing the query. ``keys``: see :meth:`ShopTables.with_keys`; the check reads
    the key columns once.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt not in ("json", "csv"):
        return ShopTables(**{name: reader.load(f"{path.rstrip('/')}/{name}") for name in TABLES}).check().with_keys(keys)
    frames = {}
    for name in TABLES:
        cols = TEXT_TYPES[name] | (types or {}).get(name, {})
        ddl = ", ".join(f"{c} {'string' if coerce else kind}" for c, kind in cols.items())
        frames[name] = reader.schema(ddl).load(f"{path.rstrip('/')}/{name}")
        if coerce:
            frames[name] = frames[name].select(*[F.col(c).try_cast(kind).alias(c) for c, kind in cols.items()])
    return ShopTables(**frames).check().with_keys(keys)


def write_tables(t: ShopTables, path: str, files_per_table: int | None = None,
                 mode: str = "errorifexists") -> str:
    """Write the five tables as Parquet under ``path`` for :func:`read_tables`.

    Orders are range-partitioned by (``orderdate``, ``orderid``) — a date with
    very many orders spreads over files — and sorted within files, so each
    file and row group covers a narrow date range and the reports'
    pushed-down year ranges skip most of them; order items are clustered by
    ``orderid`` for the same reason on the join side. ``files_per_table``
    defaults to the session's shuffle partition count.
    """
    n = files_per_table or int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    root = path.rstrip("/")
    t.orders.repartitionByRange(n, "orderdate", "orderid").sortWithinPartitions("orderdate", "orderid") \
        .write.mode(mode).parquet(f"{root}/orders")
    t.orderitems.repartitionByRange(n, "orderid").sortWithinPartitions("orderid") \
        .write.mode(mode).parquet(f"{root}/orderitems")
    for name in ("stores", "customers", "products"):
        getattr(t, name).write.mode(mode).parquet(f"{root}/{name}")
    return root


def _by_month(orders: DataFrame, files: int | None) -> DataFrame:
    """Orders with their month, dealt so that a task writes few months and a large month is spread over files."""
    month = (F.year("orderdate") * 100 + F.month("orderdate")).cast("int")
    n = files or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (orders.withColumn(MONTH, month).repartitionByRange(n, MONTH, "orderdate", "orderid")
            .sortWithinPartitions(MONTH, "orderdate", "orderid"))


def write_monthly_tables(t: ShopTables, path: str, files: int | None = None, mode: str = "errorifexists") -> str:
    """The five tables for :func:`read_tables`, orders in one folder per month.

    A report of some years then lists and reads their months only (static partition
    pruning by :meth:`ShopTables.orders_in`), and a join with a filtered table of
    months reads the months that it keeps (dynamic pruning). ``files``: how many
    files the orders are dealt over.
    """
    root = path.rstrip("/")
    _by_month(t.orders, files).write.mode(mode).partitionBy(MONTH).parquet(f"{root}/orders")
    write_items_and_dimensions(t, root, files, mode)
    return root


def write_items_and_dimensions(t: ShopTables, root: str, files: int | None, mode: str) -> None:
    n = files or int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    t.orderitems.repartitionByRange(n, "orderid").sortWithinPartitions("orderid").write.mode(mode).parquet(f"{root}/orderitems")
    for name in ("stores", "customers", "products"):
        getattr(t, name).write.mode(mode).parquet(f"{root}/{name}")


def append_orders(orders: DataFrame, path: str, files: int = 1) -> None:
    """Add orders to the monthly layout under ``path``; every batch leaves small files, see :func:`compact_orders`."""
    _by_month(orders, files).write.mode("append").partitionBy(MONTH).parquet(f"{path.rstrip('/')}/orders")


def restore_months(fs, hadoop, root: str, work: str) -> None:
    """Put back the months that a run which ended between two renames had set aside, and drop its other files."""
    if fs.exists(hadoop(work)):
        for kept in fs.listStatus(hadoop(work)):
            name = kept.getPath().getName()
            if name.startswith("old-") and not fs.exists(hadoop(f"{root}/{name[4:]}")):
                fs.rename(kept.getPath(), hadoop(f"{root}/{name[4:]}"))
        fs.delete(hadoop(work), True)


def replace_month(fs, hadoop, root: str, work: str, name: str, new: str) -> None:
    """A month's folder set aside, the new one (if it exists) put in its place, the old one deleted."""
    month, old = hadoop(f"{root}/{name}"), hadoop(f"{work}/old-{name}")
    fs.mkdirs(hadoop(work))
    if fs.exists(month) and not fs.rename(month, old):
        raise OSError(f"cannot replace {name}")
    if fs.exists(hadoop(new)) and not fs.rename(hadoop(new), month):
        raise OSError(f"cannot replace {name}")
    fs.delete(old, True)


def compact_orders(spark: SparkSession, path: str, file_bytes: int = 128 << 20, at_least: int = 2) -> list[str]:
    """Rewrite the months that have many small files into files of about ``file_bytes``; returns their folders' names.

    A month is rewritten when it has ``at_least`` times the files that its bytes
    need (two at least). Its rows are sorted into a folder beside the table, which
    then takes the month's place by two renames; readers that list the table
    between these see the month missing, so compact while no report runs. A run
    that ended between the renames is put right by the next: the month's rows lie in
    ``_compacting/`` until it is in place.
    """
    root = f"{path.rstrip('/')}/orders"
    fs, hadoop = file_system(spark, root)
    work = f"{path.rstrip('/')}/_compacting"
    restore_months(fs, hadoop, root, work)
    done = []
    for folder in fs.listStatus(hadoop(root)):
        name = folder.getPath().getName()
        if not name.startswith(f"{MONTH}="):
            continue
        sizes = [f.getLen() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        wanted = max(1, -(-sum(sizes) // file_bytes))
        if len(sizes) < max(2, at_least * wanted):
            continue
        new = f"{work}/new-{uuid.uuid4().hex[:12]}"
        (spark.read.parquet(f"{root}/{name}").repartitionByRange(wanted, "orderdate", "orderid")
         .sortWithinPartitions("orderdate", "orderid").write.parquet(new))
        replace_month(fs, hadoop, root, work, name, new)
        done.append(name)
    fs.delete(hadoop(work), True)
    return sorted(done)


def write_bucketed_tables(t: ShopTables, database: str, path: str, buckets: int,
                          mode: str = "errorifexists") -> str:
    """Save the five tables as catalog tables, orders and order items bucketed by ``orderid``.

    Both large tables get the same ``buckets`` hash buckets on the join key,
    so Spark joins them — and aggregates items per order — without shuffling
    either side (a bucketed sort-merge join). Orders are sorted by
    ``orderdate`` inside each bucket file, so the year ranges still skip row
    groups. ``path`` is the (shared) folder of the tables; size ``buckets``
    so a bucket holds a few hundred MB. Read them back with
    :func:`read_catalog_tables`.
    """
    spark = t.spark
    root = path.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}'")

    def save(df, name, bucket=False, sort=None):
        if bucket:  # a task writes one bucket, so there are at most ``buckets`` files
            df = df.repartition(buckets, "orderid")
        w = df.write.mode(mode).option("path", f"{root}/{name}")
        if bucket:
            w = w.bucketBy(buckets, "orderid").sortBy(sort)
        w.saveAsTable(f"`{database}`.`{name}`")

    save(t.orders, "orders", bucket=True, sort="orderdate")
    save(t.orderitems, "orderitems", bucket=True, sort="orderid")
    for name in ("stores", "customers", "products"):
        save(getattr(t, name), name)
    return database


def read_catalog_tables(spark: SparkSession, database: str, keys: str = "check", hot_share: float | None = 0.01) -> ShopTables:
    """The five tables of a catalog database (e.g. from :func:`write_bucketed_tables`).

    A bucket is one task's work, so orders that hold ``hot_share`` of all items or
    more are named and joined apart (None: not looked for).
    """
    t = ShopTables(**{name: spark.table(f"`{database}`.`{name}`") for name in TABLES}).check().with_keys(keys)
    return t if hot_share is None else t.with_hot_orders(hot_share)


def jdbc_options(url: str, name: str, properties: dict | None = None, table_names: dict | None = None,
                 partitions: dict | None = None) -> dict[str, str]:
    """Reader options of one table: the common ``properties``, then those of ``partitions[name]``.

    Timestamps without a zone stay that way (``preferTimestampNTZ``).
    """
    own = (partitions or {}).get(name, {})
    needed = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if own and set(own) & needed and not needed <= set(own):
        raise ValueError(f"{name}: a partitioned read needs {sorted(needed)}")
    out = {"url": url, "dbtable": (table_names or {}).get(name, name), "preferTimestampNTZ": "true"}
    return {k: str(v) for k, v in (out | (properties or {}) | own).items()}


def read_jdbc(spark: SparkSession, url: str, properties: dict | None = None,
              table_names: dict | None = None, partitions: dict | None = None, keys: str = "check") -> ShopTables:
    """Read the five tables from a relational database over JDBC.

    ``table_names`` maps a logical name to the database table (default: the
    same name). Spark pushes the reports' filters and column lists into the
    JDBC queries. ``partitions`` gives the large tables parallel reads, e.g.
    ``{"orders": {"partitionColumn": "orderid", "lowerBound": 0, "upperBound":
    10**9, "numPartitions": 400}}``; without it a table is read by one task.
    """
    frames = {name: spark.read.format("jdbc").options(**jdbc_options(url, name, properties, table_names, partitions)).load()
              for name in TABLES}
    return ShopTables(**frames).check().with_keys(keys)
