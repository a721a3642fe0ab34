"""Operator 3: sizes, targets by plain iteration, words near their targets, caps, reruns."""

from __future__ import annotations

import math
import re

import pytest

from storelens.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(size: dict, weights=(5, 2, 1), cap=3):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed, free = sum(size.values()), {}, list(names)
    while free:
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > cap * size[s]]
        if not over:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: cap * size[s] for s in over}
        free = [s for s in free if s not in over]
    return fixed


def test_sizes_targets_and_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.op3_entropy_mix(spark, SF).collect()
    text = {r.doc_id: r for r in docs.collect()}
    size = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        size[r.source] = size.get(r.source, 0) + r["size"]
    want = plain_targets(size)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in size}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in size:  # within the smallest documents' sizes, which are all that is left to adjust
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 60), s
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op3_entropy_mix(spark, SF).collect()))


def test_rates_are_exponentially_tilted(spark):
    cells = spark.createDataFrame([("a", s, n) for s, n in ((10, 50), (40, 30), (200, 9), (1000, 2))]
                                  + [("b", 10, 100)], "source string, size long, n long")
    goal = spark.createDataFrame([("a", 5500, 2750.0), ("b", 1000, 2500.0)], "source string, source_size long, target double")
    solved = {r.source: r for r in mixing.solve_rates(cells, goal).collect()}
    a, mean = solved["a"].a, solved["a"].mean
    words = sum(n * s * min(3.0, math.exp(a * s / mean)) for s, n in ((10, 50), (40, 30), (200, 9), (1000, 2)))
    assert math.isclose(words, 2750, rel_tol=1e-7) and a < 0
    assert math.isclose(math.exp(solved["b"].a), 2.5, rel_tol=1e-7)


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_sources_of_long_documents_meet_their_targets(spark, monkeypatch, block):
    """Within half of the largest document, also with a narrow range of sizes and without any small documents."""
    monkeypatch.setattr(mixing, "BLOCK_SIZES", block)
    sizes = {s: [4100 + k * 49 // 10 for k in range(1000)] for s in ("0.4", "0.6", "1.4")} | {
        "0.3": [5000 + k for k in range(50)], "0.49": [70_000 + k for k in range(300)], None: [40_000, 50_000, 60_000]}
    cells = spark.createDataFrame([(s, z, 1) for s, zs in sizes.items() for z in zs], "source string, size long, n long")
    want = {s: float(s or 2.2) * sum(zs) for s, zs in sizes.items()}
    goal = spark.createDataFrame([(s, sum(zs), want[s]) for s, zs in sizes.items()],
                                 "source string, source_size long, target double")
    got = mixing.copies_per_cell(cells, mixing.solve_rates(cells, goal)).collect()
    assert len(got) == sum(map(len, sizes.values())) and all(0 <= r.copies <= 3 for r in got)
    for s, zs in sizes.items():
        assert abs(sum(r.copies * r["size"] for r in got if r.source == s) - want[s]) <= max(zs) / 2 + 1, s


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 1000, "b": 1, "c": 1, None: 5}, {"a": 0, "b": 7, "": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    for s, t in plain_targets(sizes).items():
        assert math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-9)


def test_hot_cell_and_edges(spark, edge, none):
    hot = spark.createDataFrame([(k, "five words are in here", "hot") for k in range(3000)]
                                + [(k, "one", f"s{k % 3}") for k in range(3000, 3300)], "doc_id long, text string, source string")
    got = mixing.mix(hot).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 5
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and all(r.taken <= 3 * r["size"] for r in rows)
    assert {r.source for r in rows} == {None, "a", "b", "c", "hot", ""}
    assert mixing.mix(none).count() == 0
    assert mixing.mixing_stage(spark, none, "").count() == 0
