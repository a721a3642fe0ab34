"""Operators 8 and 9 against brute force, and connected components."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import embedding_join, graph, ngram_join
from storelens.llm.textops import shingle_set

SF = "/root/testdata/sf0.001"


def roots(n, pairs, ids):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(n)]


def plain_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = [plain_sets(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [(d, len(s), c) for (d, _), s, c in zip(rows, sets, roots(len(rows), pairs, [d for d, _ in rows]))]


def made_rows(seed):
    rnd = random.Random(seed)
    words = [f"W{k}" for k in range(2000)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([2, 4, 5, 6, 12, 40, 90]))] for _ in range(25)]
    passage = [rnd.choice(words) for _ in range(55)]
    rows = []
    for k in range(350):
        t = list(rnd.choice(base[:rnd.choice([1, 6, 25])]))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 7])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((k, " ".join(t + (passage if rnd.random() < 0.2 else []))))
    return rows


@pytest.mark.parametrize("node", [64, 3])
def test_jaccard_components(spark, monkeypatch, node):
    monkeypatch.setattr(ngram_join, "NODE", node)  # small nodes: many tree nodes in one component
    rows = made_rows(node)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.jaccard_components(df).collect()))
    assert got == plain_components(rows)


def test_jaccard_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, ngram_join.op8_ngram_jaccard(spark, SF).collect())) == plain_components(rows)


def test_jaccard_edges(spark, edge, none):
    got = ngram_join.jaccard_components(edge).collect()
    assert len(got) == edge.count()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k in (1, 2, 3, 4, 5, 6, 8, 9, 10)} | {(7, 6), (None, None)}
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.dedup_stage(spark, edge, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 3, 4, 5, 6, 8, 9, 10] and len(kept) == 10


def test_tree_bounds_never_prune_a_link():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        base = rnd.integers(0, 1 << 62, 60).astype(np.uint64)
        make = lambda: np.unique(np.concatenate((rnd.choice(base, rnd.integers(40, 60), replace=False),
                                                 rnd.integers(0, 1 << 62, rnd.integers(0, 9)).astype(np.uint64))))
        left, right = [make() for _ in range(3)], [make() for _ in range(4)]
        real = any(100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for a in left for b in right)
        nodes = [ngram_join.Node.of([ngram_join._pack(s) for s in group], 256) for group in (left, right)]
        assert ngram_join.first_link(*nodes, 75) == real


def test_packed_tokens_round_trip():
    s = shingle_set("a b c d e f g h", 5)
    assert (ngram_join._unpack(ngram_join._pack(s)) >> np.uint64(16) == s >> np.uint64(16)).all()


def brute_vectors(rows, t=0.98):
    def ok(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if ok(r) else None for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
             and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t]
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    comp = roots(len(rows), pairs, [r[0] for r in rows])
    return sorted(((r[0], k, c if u is not None else r[0]) for r, k, c, u in zip(rows, n, comp, unit)), key=str)


def test_embedding_join(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    monkeypatch.setattr(embedding_join, "LEAF", 4)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = [(int(k), (base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.12])).astype(np.float32).tolist(),
             int(rng.integers(3))) for k in range(200)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [float("nan")] + [1.0] * 7, 1), (304, [None] + [1.0] * 7, 1),
             (305, [float("inf")] * 8, 1), (306, rows[0][1], None), (None, rows[0][1], rows[0][2]), (307, [1.0, 0.0], 0),
             (308, [2.0, 0.0], 0), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_join.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind, labels", [("bigint", [1 << 40, (1 << 40) + 1, -5]), ("string", ["x", "1", ""]), ("double", [0.5, 0.0, -0.0])])
def test_label_and_vector_types(spark, kind, labels):
    """Labels of other types, vectors of doubles whose cosine lies closer to the threshold than floats can tell."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4, 6))
    rows = [(k, (base[k % 4] + rng.normal(size=6) * (k % 3) * 0.05).tolist(), labels[k % 3]) for k in range(60)]
    edge = np.array([1.0, 0.0]), np.array([0.98, np.sqrt(1 - 0.98 ** 2) * (1 + 1e-9)])  # a hair below the threshold
    rows += [(100, edge[0].tolist(), labels[0]), (101, edge[1].tolist(), labels[0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").select(
        "*", *[F.lit("clash").alias(c) for c in ("rid", "m", "n", "dims", "block")])
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_join.near_duplicates(df).collect()), key=str)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= 0.98]
    comp = roots(len(rows), pairs, [r[0] for r in rows])
    count = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert got == sorted(((r[0], int(count[i]), comp[i]) for i, r in enumerate(rows)), key=str)


def test_each_block_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 8)
    rng = np.random.default_rng(3)
    reps = spark.createDataFrame([(k, "a", rng.normal(size=5).tolist(), 1) for k in range(400)],
                                 "rid long, label string, embedding array<double>, m long")
    blocks = embedding_join._blocks(reps, {5: np.eye(5)}, 0.2).cache()
    found = sorted(map(tuple, embedding_join._pairs(blocks).collect()))
    assert len(found) == len(set(found))
    rows = blocks.select("block", "lo", "hi").collect()
    near = lambda x, y: all(a <= b + 1 and c <= d + 1 for a, b, c, d in zip(x.lo, y.hi, y.lo, x.hi))
    assert found == sorted((min(x.block, y.block), max(x.block, y.block)) for i, x in enumerate(rows) for y in rows[:i + 1] if near(x, y))


def test_embedding_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = embedding_join.op9_grid_order_join(spark, SF).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(rows)


def test_components(spark):
    rnd = random.Random(4)
    n = 120
    pairs = [(k, k + 1) for k in range(40)] + [(50, k) for k in range(51, 70)] + [(rnd.randrange(70, n), rnd.randrange(70, n)) for _ in range(40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = roots(n, pairs, list(range(n)))
    assert got == {k: want[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
