import hashlib
import zlib

import pytest

from storelens.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def item(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(*[item(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def way(levels, at):
    for level in levels[:-1]:
        s = at // 8 * 8
        yield level[s:at], level[at + 1:s + 8]
        at //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))) for g in order}
    levels = {g: tree([x[2] for x in trees[g]]) for g in order}
    top = tree([levels[g][-1][0] for g in order])
    out = []
    for gi, g in enumerate(order):
        for i, (_, doc, h, r) in enumerate(trees[g]):
            cur = h
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and r["text"] is not None:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
                cur = leaf(r, low)
            proof = ""
            for before, after in [*way(levels[g], i), *way(top, gi)]:
                proof += "".join(before + after)
                cur = H(*before, cur, *after)
            root = top[-1][0]
            out.append((doc, h, levels[g][-1][0], root, H(proof), cur, cur == root))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in df.collect()], key=str)


@pytest.mark.parametrize("levels", [1, 4])
def test_ragged_groups_against_brute_force(spark, levels):
    # one level inside a block: the other levels go through the butterfly's rounds
    sizes = {"a": 1, "b": 8, "c": 9, "d": 65, "e": 521, "f": 580, None: 71, "": 3, **{f"g{k}": 2 for k in range(6)}}
    rows = [{"doc_id": len(g or "") * 100_000 + k * 3, "text": f"Text {k} of {g}", "lang": g, "source": "s", "n_chars": k}
            for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    leaves = merkle.document_leaves(df)
    assert got(merkle.manifest(leaves, levels)) == brute(rows)


def test_edge_rows(edge, none):
    assert merkle.manifest(merkle.document_leaves(none)).count() == 0
    rows = [r.asDict() for r in edge.collect()]
    result = merkle.manifest(merkle.document_leaves(edge))
    assert got(result) == brute(rows)
    assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_positions_spread_a_repeated_row(spark):
    df = spark.range(4000).selectExpr("'x' as g", "7L as doc_id", "'same' as leaf")
    placed = merkle.positions(df, ["doc_id", "leaf"], "g")
    assert sorted(r.pos for r in placed.collect()) == list(range(4000))
    tagged = placed.select("size").distinct().collect()
    assert [r["size"] for r in tagged] == [4000]
