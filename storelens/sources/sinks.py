"""Report sink: materialise a report as a table so readers skip recomputation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``, and its Path class."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def write_report(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                 mode: str = "overwrite", fmt: str = "parquet") -> str:
    """Write ``df`` to ``path`` (Parquet by default), optionally partitioned.

    Reports are small aggregates, so no repartitioning is forced; with
    ``partition_by`` Spark writes one folder per value and later reads prune
    by it. ``overwrite`` writes a new folder beside the old one and then
    switches the names: a failed write leaves the old report, and readers
    find a whole one (on file systems with atomic renames). Returns ``path``.
    """
    def write(to: str, how: str) -> None:
        writer = df.write.mode(how).format(fmt)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(to)

    if mode != "overwrite":
        write(path, mode)
        return path
    root, tag = path.rstrip("/"), uuid.uuid4().hex[:12]
    folder, _, name = root.rpartition("/")
    new, old = (f"{folder}/.{name}-{kind}-{tag}" if folder else f".{name}-{kind}-{tag}" for kind in ("new", "old"))
    write(new, "errorifexists")
    fs, hadoop = file_system(df.sparkSession, root)
    before = fs.exists(hadoop(root))
    if before and not fs.rename(hadoop(root), hadoop(old)):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(hadoop(new), hadoop(root)):
        if before:
            fs.rename(hadoop(old), hadoop(root))
        raise OSError(f"cannot move the new report to {path}")
    if before:
        fs.delete(hadoop(old), True)
    return path


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row (the dashboard's response records), column ``json``."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def read_report(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a report written by :func:`write_report`."""
    return spark.read.format(fmt).load(path)
