"""Text sources with a rejects table: what did not parse, where, and why.

``read_with_rejects`` reads every file once. Each record is parsed as text and cast
per column; the typed columns and the list of failed values are written together
to a staging folder, from which the tables and their rejects are then read (the
rejects read one column of it). A row whose key does not parse is left out and is
found in the rejects; any other failed value becomes null. So rows kept + rows left
out = rows read, and every failed value has a line.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import ensure_checkpoint_dir
from storelens.sources.tables import TABLES, TEXT_TYPES, ShopTables

#: columns without which a row is left out
REQUIRED = {"stores": ("storeid",), "customers": ("customerid",), "orders": ("orderid",), "orderitems": ("orderid", "sku"),
            "products": ("sku",)}
_BROKEN = "_broken"
_REJECT = "array<struct<column: string, raw: string, reason: string>>"


@dataclass(frozen=True)
class ReadResult:
    """The tables; ``rejects`` (table, file, row, kept, column, raw, reason); ``counts`` (table, read, kept, left_out)."""

    tables: ShopTables
    rejects: DataFrame
    counts: DataFrame


def _reason(raw: Column, kind: str) -> Column:
    """Why a text is no value of the type."""
    blank = F.when(F.trim(raw) == "", F.lit("empty"))
    if kind.startswith(("int", "bigint", "smallint", "tinyint", "decimal")):
        return blank.when(raw.try_cast("double").isNotNull(), F.lit(f"not within {kind}")).otherwise(F.lit("not a number"))
    if kind.startswith(("timestamp", "date")):
        return blank.otherwise(F.lit("not a date"))
    return blank.otherwise(F.lit(f"not a {kind}"))


def coerce_with_rejects(raw: DataFrame, types: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns, ``_rejects`` (the failed values) and ``_kept`` (false: a required value or the whole record failed).

    ``raw`` has the columns as text, and ``_broken`` (the record's text where it
    could not be split into columns, else null) if the reader gives it. Decimals
    are rounded to their scale, as by a cast; a missing value is null, not a reject.
    """
    typed, found = {}, []
    for c, kind in types.items():
        typed[c] = F.col(c).try_cast(kind)
        if kind != "string":
            found.append(F.when(F.col(c).isNotNull() & typed[c].isNull(), F.struct(
                F.lit(c).alias("column"), F.col(c).alias("raw"), _reason(F.col(c), kind).alias("reason"))))
    broken = F.col(_BROKEN) if _BROKEN in raw.columns else F.lit(None).cast("string")
    found.append(F.when(broken.isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), broken.alias("raw"),
                                                     F.lit("broken record").alias("reason"))))
    rejects = F.filter(F.array(*found), lambda r: r.isNotNull()).cast(_REJECT)
    failed = reduce(Column.__or__, [F.col(c).isNotNull() & typed[c].isNull() for c in required], broken.isNotNull())
    return raw.select(*[v.alias(c) for c, v in typed.items()], rejects.alias("_rejects"), (~failed).alias("_kept"),
                      *[c for c in raw.columns if c in ("_file", "_row")])


def read_with_rejects(spark: SparkSession, path: str, fmt: str = "csv", types: dict | None = None, keys: str = "check",
                      staging: str | None = None, **options) -> ReadResult:
    """Read ``{path}/{table}`` (csv or json) with the rejects of every table.

    ``types`` as in :func:`storelens.sources.read_tables`; ``staging`` is the folder
    of the parsed tables (default: a new one beside the checkpoints), which the
    result reads and which stays with its owner. ``row`` numbers a table's records;
    a file's name comes with each.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"rejects are for text formats (csv, json), not {fmt!r}")
    root = (staging or f"{ensure_checkpoint_dir(spark).rstrip('/')}/parsed-{uuid.uuid4().hex}").rstrip("/")
    frames, rejects, counts = {}, [], []
    for name in TABLES:
        cols = TEXT_TYPES[name] | (types or {}).get(name, {})
        ddl = ", ".join([f"{c} string" for c in cols] + [f"{_BROKEN} string"])
        raw = (spark.read.format(fmt).options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN, **options).schema(ddl)
               .load(f"{path.rstrip('/')}/{name}")
               .select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")))
        coerce_with_rejects(raw, cols, REQUIRED[name]).write.parquet(f"{root}/{name}")
        parsed = spark.read.parquet(f"{root}/{name}")
        frames[name] = parsed.where("_kept").select(*cols)
        rejects.append(parsed.where(F.size("_rejects") > 0).select(
            F.lit(name).alias("table"), F.col("_file").alias("file"), F.col("_row").alias("row"), F.col("_kept").alias("kept"),
            F.explode("_rejects").alias("r")).select("table", "file", "row", "kept", "r.*"))
        counts.append(parsed.agg(F.count(F.lit(1)).alias("read"), F.count(F.when(F.col("_kept"), 1)).alias("kept"),
                                 F.count(F.when(~F.col("_kept"), 1)).alias("left_out")).select(F.lit(name).alias("table"), "*"))
    return ReadResult(ShopTables(**frames).check().with_keys(keys), reduce(DataFrame.unionByName, rejects),
                      reduce(DataFrame.unionByName, counts))


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Number of rejected values per table, column and reason."""
    return rejects.groupBy("table", "column", "reason").agg(F.count(F.lit(1)).alias("values"))
