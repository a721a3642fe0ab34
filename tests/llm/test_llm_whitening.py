import numpy as np
import pytest

from storelens.llm import whitening as w


def table(spark, vectors, extra=()):
    rows = [(i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def direct(vectors, k=4):
    x = np.array([np.floor(256 * np.array(v)) for v in vectors])
    u = np.unique(x, axis=0)
    cov = np.cov(u.T, bias=True).reshape(u.shape[1], u.shape[1])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return x, u, values, (x - u.mean(0)) @ axes / np.sqrt(values), np.trace(cov)


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(3)
    for values in (np.zeros(6), np.array([0, 0, 1, 1, 1, 5.0]), np.sort(rng.random(6)), np.array([1, 1 + 1e-15, 2, 3, 4, 5])):
        vectors, _ = np.linalg.qr(rng.standard_normal((6, 6)))
        for x in (rng.standard_normal(6), vectors[:, 2] * 3, np.zeros(6), rng.standard_normal(6) * 1e-9):
            got, axes = w.rank_one(values, vectors, x)
            whole = (vectors * values) @ vectors.T + np.outer(x, x)
            assert np.allclose(got, np.linalg.eigvalsh(whole), atol=1e-13)
            assert np.allclose(axes.T @ axes, np.eye(6), atol=1e-12)
            assert np.allclose((axes * got) @ axes.T, whole, atol=1e-12)


@pytest.mark.parametrize("batch", [1, 16, 1000])
def test_spectra_of_parts_merge_to_the_whole(batch):
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((300, 9)) * 50) + 1000
    x[:, 3] = x[:, 2]  # rank deficient
    total = w.Spectrum(9)
    for part in np.array_split(x, 7):
        own = w.Spectrum(9)
        for i in range(0, len(part), batch):
            own.add(part[i:i + batch])
        total.merge(own)
    scatter = np.cov(x.T, bias=True) * 300
    assert total.n == 300 and np.allclose(total.mean, x.mean(0))
    assert np.allclose((total.vectors * total.values) @ total.vectors.T, scatter, atol=1e-9 * scatter.trace())


def test_against_direct_decomposition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((400, 12)) * np.linspace(0.1, 1, 12)).tolist()
    vectors += vectors[:150]  # repeated vectors count once
    x, u, values, y, trace = direct(vectors)
    r = w.whitened(table(spark, vectors).repartition(20)).toPandas().sort_values(["vec_id", "component"])
    assert (r.n == len(u)).all() and len(r) == 4 * len(x)
    got = r.whitened.to_numpy().reshape(-1, 4)
    sign = np.sign((got * y).sum(0))
    assert np.abs(got * sign - y).max() < 1e-9
    assert np.allclose(r.explained.to_numpy()[:4], values / trace, rtol=1e-12)
    s = u.sum(0)
    assert r.deviation.to_numpy()[::4].tolist() == [int(sum((len(u) * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))) for v in x]
    assert r.identity_error.nunique() == 1 and r.identity_error.iloc[0] < 1e-10


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]),
            (8, [3.0, 1.0]), (8, [3.0, 1.0]), (None, [0.5, 0.25]), (9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "'clash' as x", "'clash' as n", "1 as component", "'c' as _d")
    r = w.whitened(df).toPandas()
    assert sorted(r.vec_id.fillna(-1).tolist()) == sorted([1, 1, 8, 8, 8, 8, -1, -1, 9, 9])
    assert (r.n == 4).all() and r.whitened.notna().all()
    assert w.whitened(df.where("false")).count() == 0
    same = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert w.whitened(same).count() == 0  # no component has a positive eigenvalue
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<float>")
    assert w.whitened(line).select("component").distinct().count() == 1
    huge = spark.createDataFrame([(k, [3e9 * k, 1.0]) for k in range(3)], "vec_id long, embedding array<double>")
    big = {r.vec_id: r.deviation for r in w.whitened(huge).collect()}
    assert big == {0: None, 1: 0, 2: None}
