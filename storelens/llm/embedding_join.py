"""Embedding near-duplicates by an epsilon grid order join (operator 9).

Vectors of one label are compared by cosine; cosine >= t means a Euclidean
distance of the unit vectors of at most eps = sqrt(2 - 2t). The unit vectors are
projected on a few principal axes and sorted by their cells of side eps on
these. The sorted sequence is cut into blocks; two blocks are joined only if
their cells may hold vectors within eps, and inside a pair of blocks the two
sequence intervals are halved recursively, skipping intervals whose cells are
more than one apart on any axis. What remains is compared exactly, in double
precision.

The axes come from a bounded sample (``SAMPLE`` vectors by hash); they decide
only what can be skipped, never what is linked. Equal vectors are joined once,
with their number. A pair of blocks returns, per vector, how many vectors it
links with, and the edges of a spanning forest: never all pairs.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component, or whose label or vec_id is null, links with nothing
(n_links 0, component_id = vec_id, kept true); vectors of different lengths do
not link; labels of any simple type are compared as they are, vectors of floats or
doubles in double precision; a repeated row counts as another vector; extra columns are not
carried over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm.common import checkpointed, table
from storelens.llm.graph import components

AXES = 6            #: principal axes of the grid
KEYED = 3           #: axes whose cells are keys of the join of blocks
SAMPLE = 10_000     #: vectors the axes are fitted on at most
BLOCK = 1024        #: vectors of a block at most
LEAF = 128          #: intervals up to this size are compared outright


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions of the unit vectors, per vector length."""
    rows = reps.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("embedding").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.embedding), []).append(r.embedding)
    axes = {}
    for d, vectors in by_size.items():
        x = _unit(np.array(vectors, float))
        _, vec = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))
        axes[d] = vec[:, ::-1][:, :AXES]
    return axes


def _cells(unit: np.ndarray, axes: dict[int, np.ndarray], eps: float) -> np.ndarray:
    d = unit.shape[1]
    on = axes.get(d)
    if on is None:  # a length that the sample did not hold: its first coordinates
        on = np.eye(d)[:, :AXES]
    cells = np.floor(unit @ on / eps).astype(np.int32)
    return np.pad(cells, ((0, 0), (0, AXES - cells.shape[1])))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def join_intervals(xa: np.ndarray, ca: np.ndarray, xb: np.ndarray, cb: np.ndarray, threshold: float, same: bool):
    """Yield (i, j) index arrays of linked vectors of two sorted intervals; i < j where they are the same."""
    stack = [(0, len(xa), 0, len(xb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0 + 1:
            continue  # below the diagonal
        if ((ca[a0:a1].min(0) > cb[b0:b1].max(0) + 1) | (cb[b0:b1].min(0) > ca[a0:a1].max(0) + 1)).any():
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(xa[a0:a1] @ xb[b0:b1].T >= threshold)
            i, j = i + a0, j + b0
            yield (i[i < j], j[i < j]) if same else (i, j)
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]


def _blocks(reps: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Sorted sequence blocks: (block, label, dims, lo, hi, n, rid, m, unit, cell), the last four packed."""
    shared = reps.sparkSession.sparkContext.broadcast(axes)
    cell_cols = [f"c{i}" for i in range(AXES)]

    def locate(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            cells = np.zeros((b.num_rows, AXES), np.int32)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
            start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = flat[lists.offsets[0].as_py() if len(lists.values) > start[-1] else 0:]
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = flat[start[at][:, None] + np.arange(d)]
                cells[at] = _cells(_unit(x), shared.value, eps)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(cells[:, k]) for k in range(AXES)]],
                                             [*b.schema.names, *cell_cols])

    def pack(batches):
        seq, held, key = 0, [], None

        def flush():
            nonlocal seq
            raw = np.array([h[1] for h in held], float)
            cells = np.array([h[3] for h in held], np.int32)
            seq += 1
            return pa.RecordBatch.from_arrays([
                pa.array([(TaskContext.get().partitionId() << 32) + seq], pa.int64()), pa.array([key[0]], pa.string()),
                pa.array([key[1]], pa.int32()), pa.array([cells.min(0).tolist()], pa.list_(pa.int32())),
                pa.array([cells.max(0).tolist()], pa.list_(pa.int32())), pa.array([len(held)], pa.int32()),
                pa.array([np.array([h[0] for h in held], np.int64).tobytes()]),
                pa.array([np.array([h[2] for h in held], np.int64).tobytes()]),
                pa.array([_unit(raw).tobytes()]), pa.array([cells.tobytes()])],
                ["block", "label", "dims", "lo", "hi", "n", "rid", "m", "unit", "cell"])

        for b in batches:
            cells = np.stack([b.column(k).to_numpy() for k in range(4, 4 + AXES)], 1) if b.num_rows else None
            for i, (rid, label, emb, m) in enumerate(zip(*[b.column(k).to_pylist() for k in range(4)])):
                if held and (key != (label, len(emb)) or len(held) >= BLOCK):
                    yield flush()
                    held.clear()
                key = label, len(emb)
                held.append((rid, emb, m, cells[i]))
        if held:
            yield flush()

    located = reps.select("rid", "label", "embedding", "m").mapInArrow(
        locate, f"rid long, label string, embedding {reps.schema['embedding'].dataType.simpleString()}, m long, "
        + ", ".join(f"{c} int" for c in cell_cols))
    order = [F.col("label"), F.size("embedding"), *map(F.col, cell_cols), F.col("rid")]
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (located.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .mapInArrow(pack, "block long, label string, dims int, lo array<int>, hi array<int>, n int, rid binary, "
                              "m binary, unit binary, cell binary"))


def _pairs(blocks: DataFrame) -> DataFrame:
    """(a, b), a <= b: blocks of one label and length whose cells may hold vectors within eps.

    Joined on the cells of the first ``KEYED`` axes that a block covers, or touches;
    a pair meets at one cell only, the larger of both blocks' least cells.
    """
    head = blocks.select("block", "label", "dims", "lo", "hi")
    keys = [f"c{k}" for k in range(KEYED)]
    for k, c in enumerate(keys):
        head = head.withColumn(c, F.explode(F.expr(f"sequence(lo[{k}], hi[{k}] + 1)")))
    once = " and ".join(f"a.c{k} = greatest(a.lo[{k}], b.lo[{k}])" for k in range(KEYED))
    near = F.expr("forall(sequence(0, size(a.lo) - 1), i -> a.lo[i] <= b.hi[i] + 1 and b.lo[i] <= a.hi[i] + 1)")
    same = F.lit(True)
    for c in ["label", "dims", *keys]:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    return (head.alias("a").join(head.alias("b"), same & (F.col("a.block") <= F.col("b.block")) & F.expr(once) & near)
            .select(F.col("a.block").alias("a"), F.col("b.block").alias("b")))


def _join_blocks(pairs: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, n, b): vector a links with n vectors of a pair of blocks; b not null: an edge of the forest instead."""
    packed = ["rid", "m", "unit", "cell"]
    left = blocks.select(F.col("block").alias("a"), "dims", *[F.col(c).alias(f"a_{c}") for c in packed])
    right = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in packed])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                ids = [np.frombuffer(r[f"{s}_rid"], np.int64) for s in "ab"]
                m = [np.frombuffer(r[f"{s}_m"], np.int64) for s in "ab"]
                x = [np.frombuffer(r[f"{s}_unit"]).reshape(-1, r["dims"]) for s in "ab"]
                c = [np.frombuffer(r[f"{s}_cell"], np.int32).reshape(-1, AXES) for s in "ab"]
                shift = 0 if same else len(ids[0])
                every = ids[0] if same else np.concatenate(ids)
                count = np.zeros(len(every), np.int64)
                forest, edges = _Forest(len(every)), []
                for i, j in join_intervals(x[0], c[0], x[1], c[1], threshold, same):
                    np.add.at(count, i, m[1][j])
                    np.add.at(count, j + shift, m[0][i])
                    edges += [(p, q) for p, q in zip(i.tolist(), (j + shift).tolist()) if forest.join(p, q)]
                at = np.flatnonzero(count)
                if len(at):
                    p, q = np.array(edges).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((every[at], every[p]))),
                         pa.array(np.concatenate((count[at], np.zeros(len(p), np.int64)))),
                         pa.array([None] * len(at) + every[q].tolist(), pa.int64())], ["a", "n", "b"])

    rows = pairs.join(left, "a").join(right, "b")
    cols = ["a", "b", "dims", *[f"a_{c}" for c in packed], *[f"b_{c}" for c in packed]]
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*cols).repartition(n, "a", "b").mapInArrow(run, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    eps = float(np.sqrt(max(2 - 2 * threshold, 1e-12))) * (1 + 1e-9)
    usable = F.expr("""vec_id is not null and label is not null and size(embedding) > 0
        and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))
        and exists(embedding, x -> x <> 0)""")
    # labels are compared as text, which tells values of any one type apart (0.0 and -0.0 are one label)
    label = F.col("label")
    if isinstance(vectors.schema["label"].dataType, (T.FloatType, T.DoubleType)):
        label = label + F.lit(0.0)
    narrow = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), True)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("string").alias("label"),
                          F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    rows = rows.withColumn("rid", F.when(F.coalesce(usable, F.lit(False)),
                                         F.xxhash64("label", "embedding", F.size("embedding"))))
    reps = checkpointed(rows.where("rid is not null").groupBy("rid").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least")))
    blocks = checkpointed(_blocks(reps, _principal_axes(reps), eps))
    found = checkpointed(_join_blocks(_pairs(blocks), blocks, threshold))
    links = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rid")
    known = reps.select("rid", "m", "least").join(links, "rid", "left").join(roots, "rid", "left")
    known = checkpointed(known.select("rid", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                                      F.coalesce("root", "rid").alias("root"), "least"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("rid", "n_links", "component_id")
    return (rows.select("vec_id", "rid").join(known, "rid", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op9_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
