"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storelens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (eager, survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 where the id is null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(-1))


def labelled_sample(docs: DataFrame, keys: DataFrame, cls: Column, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``per_class`` labelled documents of each class, as (text, cls).

    ``keys`` holds ids and whatever ``cls`` needs. Ids are taken in the order
    of their hash, so reruns take the same ones; rows with a null id or class
    are left out. An id counts once however often it is labelled (the smallest class)
    and however many documents carry it (the one whose text has the smallest hash).
    Before ids are ranked, a cut by their hash leaves about ``2 * per_class`` of each
    class; the join then carries a bounded id list.
    """
    from pyspark.sql import Window

    ids = (keys.select(F.col(id_col).alias("_id"), cls.alias("_cls")).where("_id is not null and _cls is not null")
           .groupBy("_id").agg(F.min("_cls").alias("_cls")))
    size = ids.groupBy("_cls").agg(F.count(F.lit(1)).alias("_n"))
    cut = F.xxhash64("_id") / F.lit(2.0 ** 64) + 0.5 <= (2 * per_class + 50) / F.col("_n")
    w = Window.partitionBy("_cls").orderBy(F.xxhash64("_id"), F.col("_id"))
    ids = (ids.join(size, "_cls").where(cut).withColumn("_rn", F.row_number().over(w))
           .where(F.col("_rn") <= per_class).select("_id", "_cls"))
    text = F.coalesce("_text", F.lit(""))
    one = F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("t")))
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(ids), "_id").groupBy("_id", "_cls").agg(one.alias("_one"))
            .select(F.xxhash64("_id").alias("_h"), "_id", F.col("_one.t").alias("text"), F.col("_cls").alias("cls")))


def _pieces(batch: pa.RecordBatch, at: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(at)])
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_text(df: DataFrame, schema: str, fn: Callable[[pa.Array], list], keep: list[str],
             text_col: str = "text") -> DataFrame:
    """``keep`` columns plus the columns that ``fn(texts)`` returns, batch by batch.

    ``fn`` gets a string array (nulls kept) and returns one list, array or
    numpy array per column of ``schema``.
    """
    names = StructType.fromDDL(schema).names
    fields = [df.schema[c] for c in keep]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [schema])

    cols_in = keep if text_col in keep else [*keep, text_col]
    at = cols_in.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _pieces(whole, at):
                cols = fn(b.column(at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(keep))] + [c if isinstance(c, pa.Array) else pa.array(c) for c in cols],
                    [*keep, *names])
            pa.default_memory_pool().release_unused()

    return df.select(*cols_in).mapInArrow(run, out)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0,
                 steps: int = 50) -> np.ndarray:
    """Weights (last one the intercept) of a logistic regression on soft labels, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    s = np.ones(len(a)) if weight is None else weight
    reg = np.full(a.shape[1], l2)
    reg[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (s * (p - y)) + reg * w
        hess = (a * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        scale = min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= scale * step
        if np.abs(step).max() < 1e-8:
            break
    return w
