"""Embedding whitening by incremental eigendecomposition (operator 13).

A vector becomes whole numbers x = floor(256 * c); the fit list holds each distinct x
once. Every partition of the list builds the spectrum (eigenvalues and vectors) of
its scatter about its own mean: a batch of rows is first reduced to its triangular
factor, whose rows - and the shift of the mean - enter as centred rank-one updates.
A rank-one update solves the secular equation for all roots at once (bracketed
Newton steps in coordinates from the nearest pole); components of the update that
vanish and poles that coincide are deflated. Spectra are merged pairwise in a tree of
tasks: each scaled eigenvector of one, and the shift between the means, are
rank-one updates of the other.

The merged basis is then refined: one more pass projects the centred list on it and
a Rayleigh-Ritz step diagonalises the projected covariance, which leaves the
components exact to double precision. Means and sums are exact integers.

Defined results: null vectors and vectors with null or non-finite entries are left
out, also empty ones and those whose length is not the most frequent one (ties: the
longest); equal vectors count once in the fit and get a row each; only components
with an eigenvalue above the rounding error of the largest are returned (none if all
vectors are equal); a deviation beyond 64 bits is null; an empty table gives no
rows; extra columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, table

COMPONENTS = 4
BATCH = 1024   #: rows reduced together before their rank-one updates
MERGE = 8      #: spectra that one task merges


# ---------------------------------------------------------------- spectra

def secular_roots(poles: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weight / (poles - mu)) = 0 for ascending, distinct poles and positive weights.

    Returns (index of the nearest pole, offset from it, gaps), where
    ``gaps[i, j] = poles[i] - root j``, accurate even for close roots.
    """
    n = len(poles)
    after = np.append(poles[1:], poles[-1] + weight.sum())
    middle = (poles + after) / 2
    value = 1 + (weight[:, None] / (poles[:, None] - middle[None])).sum(0)
    origin = np.where((value < 0) & (np.arange(n) < n - 1), np.minimum(np.arange(n) + 1, n - 1), np.arange(n))
    base = poles[origin]
    shifted = poles[:, None] - base[None]
    low, high = np.where(origin == np.arange(n), 0.0, middle - base), np.where(origin == np.arange(n), middle - base, 0.0)
    high[-1] = after[-1] - base[-1]
    low[-1] = 0.0
    at = (low + high) / 2
    for _ in range(80):
        gaps = shifted - at
        gaps[gaps == 0] = np.finfo(float).tiny
        part = weight[:, None] / gaps
        f = 1 + part.sum(0)
        low, high = np.where(f < 0, at, low), np.where(f >= 0, at, high)
        # Newton on the equation times the distance to the origin's pole, which is nearly straight there
        slope = (part / gaps).sum(0)
        step = f * at / (f + at * slope)
        new = at - step
        new = np.where((new >= low) & (new <= high) & (new != 0), new, (low + high) / 2)
        done = np.abs(new - at) <= 1e-15 * np.abs(at)
        at = new
        if done.all() or (high - low <= 4e-16 * np.maximum(np.abs(low), np.abs(high))).all():
            break
    gaps = shifted - at
    gaps[gaps == 0] = np.finfo(float).tiny
    return origin, at, gaps


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors (columns) of ``V diag(values) V' + x x'``, by the secular equation."""
    z = vectors.T @ x
    size = float(z @ z)
    if size == 0.0:
        return values, vectors
    scale = max(float(values[-1]), size)
    vectors = vectors.copy()
    # deflation: coinciding poles are rotated until one of them carries their whole weight
    live = np.abs(z) * np.sqrt(size) > 1e-16 * scale
    idx = np.flatnonzero(live)
    close = np.flatnonzero(np.diff(values[idx]) <= 1e-14 * scale)
    for k in close:
        i, j = idx[k], idx[k + 1]
        r = np.hypot(z[i], z[j])
        if r:
            c, s = z[j] / r, z[i] / r
            a, b = vectors[:, i].copy(), vectors[:, j].copy()
            vectors[:, i], vectors[:, j] = c * a - s * b, s * a + c * b
            z[i], z[j] = 0.0, r
            live[i] = False
    idx = np.flatnonzero(live)
    if not len(idx):
        return values, vectors
    poles = values[idx].copy()
    origin, offset, gaps = secular_roots(poles, z[idx] ** 2)
    out = values.copy()
    out[idx] = poles[origin] + offset
    # weights that make the computed roots exact (keeps the vectors orthogonal), from the gaps
    n = len(idx)
    ratio = -gaps
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    shares = ratio / np.where(between == 0, 1.0, between)
    shares[np.arange(n), np.arange(n)] = ratio[np.arange(n), np.arange(n)]
    fitted = np.sqrt(np.abs(np.prod(shares, axis=1))) * np.where(z[idx] < 0, -1, 1)
    q = fitted[:, None] / gaps
    q /= np.linalg.norm(q, axis=0)
    vectors[:, idx] = vectors[:, idx] @ q
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


class Spectrum:
    """Number of rows, mean, and the eigenvalues and vectors of the scatter about the mean."""

    def __init__(self, d: int):
        self.n, self.mean = 0, np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def _update(self, x: np.ndarray):
        self.values, self.vectors = rank_one(self.values, self.vectors, x)

    def _shift(self, n: int, mean: np.ndarray):
        """Account for ``n`` more rows with this mean, whose scatter is added by the caller."""
        total = self.n + n
        delta = mean - self.mean
        if self.n:
            self._update(delta * np.sqrt(self.n * n / total))
        self.mean = self.mean + delta * (n / total)
        self.n = total

    def add(self, rows: np.ndarray):
        """A batch of rows: its centred triangular factor and the mean's shift, one rank-one update each."""
        mean = rows.mean(0)
        centred = rows - mean
        if len(rows) > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        self._shift(len(rows), mean)
        for x in centred:
            self._update(x)

    def merge(self, other: Spectrum):
        self._shift(other.n, other.mean)
        for value, x in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._update(np.sqrt(value) * x)

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, d: int) -> Spectrum:
        a = np.frombuffer(raw)
        s = cls(d)
        s.n, s.mean, s.values = int(a[0]), a[1:1 + d].copy(), a[1 + d:1 + 2 * d].copy()
        s.vectors = a[1 + 2 * d:].reshape(d, d).copy()
        return s


# ---------------------------------------------------------------- passes over the table

def _matrix(b: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    return b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _tree(parts: DataFrame, d: int) -> Spectrum:
    """All spectra of ``parts`` (number, spectrum) merged, ``MERGE`` of them a task, round by round."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = Spectrum(d)
        for raw in rows["spectrum"]:
            total.merge(Spectrum.unpack(raw, d))
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // MERGE], "spectrum": [total.pack()]})

    parts = checkpointed(parts)
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = checkpointed(parts.groupBy((F.col("part") / MERGE).cast("bigint").alias("run"))
                             .applyInPandas(merge, "part bigint, spectrum binary"))
        most //= MERGE
    return Spectrum.unpack(parts.first().spectrum, d)


def spectrum(fit: DataFrame, d: int, batch: int = BATCH) -> Spectrum:
    """The spectrum of a table with one vector column ``x`` (long arrays of length ``d``)."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(d)
        held: list[np.ndarray] = []
        for b in batches:
            held.append(_matrix(b, 0, d).astype(float))
            while sum(map(len, held)) >= batch:
                rows = np.vstack(held)
                for i in range(0, len(rows) - batch + 1, batch):
                    own.add(rows[i:i + batch])
                held = [rows[len(rows) // batch * batch:]]
        rest = np.vstack(held) if held else np.empty((0, d))
        if len(rest):
            own.add(rest)
        if own.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "spectrum": pa.array([own.pack()], pa.binary())})

    return _tree(fit.select("x").mapInArrow(run, "part bigint, spectrum binary"), d)


def _moments(fit: DataFrame, project, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of ``project(rows)`` over the list, centred before multiplying; partials merge by Chan's rule."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = project(_matrix(b, 0, b.column(0).value_lengths()[0].as_py()))
                n, mean, m2 = _chan((n, mean, m2), (len(y), y.mean(0), (y - y.mean(0)).T @ (y - y.mean(0))))
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "mean": pa.array([mean.tolist()]),
                                              "m2": pa.array([m2.ravel().tolist()])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(k), np.zeros((k, k)))
        for b in batches:
            for r in b.to_pylist():
                total = _chan(total, (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(k, k)))
        if total[0]:
            yield pa.RecordBatch.from_pydict({"n": pa.array([total[0]], pa.int64()), "mean": pa.array([total[1].tolist()]),
                                              "m2": pa.array([total[2].ravel().tolist()])})

    schema = "n bigint, mean array<double>, m2 array<double>"
    parts = fit.select("x").mapInArrow(run, schema).repartition(16, F.spark_partition_id())
    total = (0, np.zeros(k), np.zeros((k, k)))
    for r in sorted(parts.mapInArrow(merge, schema).collect(), key=lambda r: (r.n, r.mean)):  # one row a partition
        total = _chan(total, (r.n, np.array(r.mean), np.array(r.m2).reshape(k, k)))
    return total[1], total[2] / max(total[0], 1)


def _chan(a, b):
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """(n, sum per dimension, sum of squares per dimension), exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q, n = [0] * d, [0] * d, 0
        for b in batches:
            x = _matrix(b, 0, d)
            if len(x):
                if np.abs(x.astype(float)).max() > 1 << 20:  # sums of squares may leave 64 bits
                    x = x.astype(object)
                s = [a + int(v) for a, v in zip(s, x.sum(0), strict=True)]
                q = [a + int(v) for a, v in zip(q, (x * x).sum(0), strict=True)]
                n += len(x)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                          "s": pa.array([str(v) for v in s]), "q": pa.array([str(v) for v in q])})

    rows = (fit.select("x").mapInArrow(run, "dim int, n bigint, s string, q string").groupBy("dim")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
                 F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).orderBy("dim").collect())  # one row a dimension
    return int(rows[0].n), [int(r.s) for r in rows], [int(r.q) for r in rows]


class Whitening:
    """The fitted transform: ``n``, exact sums, components (columns), eigenvalues, share explained."""

    def __init__(self, fit: DataFrame, d: int, components: int = COMPONENTS, batch: int = BATCH):
        self.n, self.sums, squares = _sums(fit, d)
        self.mean = np.array([s / self.n for s in self.sums])
        self.trace = sum(self.n * q - s * s for s, q in zip(self.sums, squares, strict=True)) / self.n ** 2
        basis, _ = np.linalg.qr(spectrum(fit, d, batch).vectors)
        mean = self.mean
        # Rayleigh-Ritz: the covariance in the merged basis, diagonalised
        _, cov = _moments(fit, lambda x: (x - mean) @ basis, d)
        values, inside = np.linalg.eigh((cov + cov.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > max(values.max(), 0) * d * 1e-15]
        self.values, self.axes = values[order], basis @ inside[:, order]
        self.axes /= np.linalg.norm(self.axes, axis=0)

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes / np.sqrt(self.values)

    def identity_error(self, fit: DataFrame) -> float:
        k = len(self.values)
        mean, axes, root = self.mean, self.axes, np.sqrt(self.values)
        _, cov = _moments(fit, lambda x: (x - mean) @ axes / root, k)
        return float(np.abs(cov - np.eye(k)).max())


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) of the usable vectors as whole numbers, and their length."""
    ok = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda v: F.coalesce(
        F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(v.cast("double"), F.lit(0.0))))
    rows = vectors.select(F.col(id_col), F.transform(vector_col, lambda v: F.floor(v.cast("double") * 256.0)).alias("x"),
                          F.size(vector_col).alias("_d")).where(ok & (F.size(vector_col) > 0))
    most = rows.groupBy("_d").count().orderBy(F.desc("count"), F.desc("_d")).first()
    d = most["_d"] if most else 0
    return rows.where(F.col("_d") == d).select(id_col, "x"), d


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: its whitened coordinate and the fit's figures."""
    rows, d = whole_vectors(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = checkpointed(rows.select("x").distinct())
    w = Whitening(fit, d, components)
    k = len(w.values)
    error = w.identity_error(fit) if k else 0.0
    mean, axes, root, n, sums = w.mean, w.axes, np.sqrt(w.values), w.n, w.sums
    explained = w.values / w.trace if k else w.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = _matrix(b, 1, d), b.num_rows
            if not rows or not k:
                continue
            most = n * (np.abs(x.astype(float)).max() + 1) + max(abs(s) for s in sums)
            if d * most * most < 9e18:
                part = x * n - np.array(sums, np.int64)
                deviation = (part * part).sum(1).tolist()
            else:
                deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
                deviation = [v if v < 1 << 63 else None for v in deviation]
            y = (x - mean) @ axes / root
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n)), pa.array([deviation[i] for i in each], pa.int64()), pa.array(y.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_secular_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their four leading whitened components."""
    return whitened(table(spark, sf_dir, "embeddings"))
