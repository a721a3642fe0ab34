"""Orders as a change feed: a base table, and versions of rows that replace or delete them.

A change has the columns of orders, ``version`` (any ordered type; the largest wins)
and ``deleted``. Of an order's changes only the latest counts; deliveries may repeat
and come in any order. :func:`with_changes` reads base and changes together;
:func:`apply_changes` writes them into the monthly layout, touching the months that
hold or get a changed order and no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.joins import fits_broadcast
from storelens.sources.sinks import file_system
from storelens.sources.tables import MONTH, ShopTables, _by_month, replace_month, restore_months


def latest_changes(changes: DataFrame) -> DataFrame:
    """One row per order: its latest version (of equal versions a deletion, then the largest row).

    The maximum is partial in every task, so an order with very many versions sends
    one row a task.
    """
    rest = [c for c in changes.columns if c not in ("orderid", "version", "deleted")]
    gone = F.coalesce(F.col("deleted"), F.lit(False))
    newest = F.max(F.struct(F.col("version"), gone.alias("deleted"), *rest)).alias("_v")
    return (changes.where(F.col("orderid").isNotNull()).groupBy("orderid").agg(newest)
            .select("orderid", *[F.col(f"_v.{c}") for c in ["version", "deleted", *rest]]))


def with_changes(t: ShopTables, changes: DataFrame) -> ShopTables:
    """The bundle whose orders are the base's with the latest changes in their place.

    The changed ids are broadcast if they provably fit, else both sides are shuffled
    by order id once.
    """
    newest = latest_changes(changes)
    ids = newest.select("orderid")
    kept = t.orders.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "orderid", "left_anti")
    new = newest.where("not deleted").select(*[F.col(c) if c in newest.columns else F.lit(None).alias(c) for c in t.orders.columns])
    return t.with_orders(kept.select(*t.orders.columns).unionByName(new))


def apply_changes(spark: SparkSession, t: ShopTables, path: str, changes: DataFrame, files: int | None = None) -> list[str]:
    """Write the latest changes into the monthly layout at ``path`` (of which ``t`` is the bundle); the rewritten months.

    The months to rewrite are those of the changed orders' present rows, found by a
    semi join that reads ids and months only, and those of their new dates. Each is
    written beside the table and then takes the old one's place, which is set aside
    until then. A run that ended halfway can be repeated: months set aside are put
    back first, and applying a change twice changes nothing. ``t`` is read again after
    such an end (its file list is older).
    """
    root, work = f"{path.rstrip('/')}/orders", f"{path.rstrip('/')}/_changing"
    fs, hadoop = file_system(spark, root)
    restore_months(fs, hadoop, root, work)
    newest = latest_changes(changes)
    ids = newest.select("orderid")
    if fits_broadcast(ids):
        ids = F.broadcast(ids)
    new = newest.where("not deleted").select(F.year("orderdate") * 100 + F.month("orderdate"))
    touched = (t.orders.select("orderid", MONTH).join(ids, "orderid", "left_semi").select(MONTH)
               .unionByName(new.toDF(MONTH).select(F.col(MONTH).cast("int").alias(MONTH))).distinct())
    months = sorted((r[MONTH] for r in touched.collect()), key=lambda m: (m is None, m or 0))  # a few thousand at most
    if not months:
        return []
    here = F.col(MONTH).isin([m for m in months if m is not None])
    if None in months:
        here = here | F.col(MONTH).isNull()
    old = t.orders.where(here).join(ids, "orderid", "left_anti")
    columns = [c for c in t.orders.columns if c != MONTH]
    rows = old.select(*columns).unionByName(newest.where("not deleted").select(*columns))
    made = f"{work}/new-{uuid.uuid4().hex[:12]}"
    _by_month(rows, files).write.partitionBy(MONTH).parquet(made)
    done = []
    for m in months:
        name = f"{MONTH}={'__HIVE_DEFAULT_PARTITION__' if m is None else m}"
        replace_month(fs, hadoop, root, work, name, f"{made}/{name}")
        done.append(name)
    fs.delete(hadoop(work), True)
    return done
