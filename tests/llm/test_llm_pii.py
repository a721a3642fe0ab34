import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import pii
from storelens.llm.crf_lstm import Tagger, classes

PROSE = ["the quick brown fox jumps over a lazy dog and runs on through the wet fields until night",
         "eine Zeile mit einfachen Wörtern, in die etwas geschrieben wird, das man dann finden soll",
         "une ligne de mots simples où l'on écrit quelque chose que l'on doit retrouver plus tard"]


@pytest.fixture(scope="module")
def model():
    codes, gold = pii.training_rows([], PROSE)
    m = Tagger(len(pii.KINDS))
    m.fit(codes, gold, 220)
    return m


def plain(text):
    """The base spans by Python's backtracking matcher, pattern by pattern."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(1)
    pieces = ["a", "b.", "@", ".", "-", " ", "+", "1", "22", "333", "(", ")", "é", "4111111111111111", "10.0.0.1", "x@y.z", "+1 (213) 555-5044", "%", "_"]
    for _ in range(4000):
        text = "".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(0, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "+1(" * 100_000, "a@" * 150_000):
        pii.base_spans(text)
        pii.windows_of(text)


def test_gradient_is_exact():
    rng = np.random.default_rng(2)
    m = Tagger(2, hidden=5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    codes, gold = rng.integers(0, 99, (3, 7)), rng.integers(0, 5, (3, 7))
    _, grad = m.gradient(codes, gold)
    for name, g in grad.items():
        flat = m.p[name].reshape(-1)
        spots = [int(np.abs(g).argmax()), int(rng.integers(flat.size))]
        for k in spots:
            old, step = flat[k], 1e-3
            flat[k] = old + step
            up = m.gradient(codes, gold)[0]
            flat[k] = old - step
            down = m.gradient(codes, gold)[0]
            flat[k] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 2e-3 * max(1, abs(g).max()), name


def test_decode_is_the_best_path():
    rng = np.random.default_rng(3)
    m = Tagger(1, hidden=4)
    for k in "tse":
        m.p[k] = rng.standard_normal(m.p[k].shape).astype(np.float32)
    codes = rng.integers(0, 99, (4, 5))
    em = m._emissions(m._states(codes)[1])
    labels, _ = m.decode(codes)
    import itertools
    for r in range(4):
        paths = [p for p in itertools.product(range(3), repeat=5)
                 if p[0] != 2 and all(b != 2 or a in (1, 2) for a, b in itertools.pairwise(p))]
        score = [sum(em[t, r, x] for t, x in enumerate(p)) + m.p["s"][p[0]] + m.p["e"][p[-1]]
                 + sum(m.p["t"][a, b] for a, b in itertools.pairwise(p)) for p in paths]
        assert tuple(labels[r]) == paths[int(np.argmax(score))]


def test_windows_cover_every_trigger():
    rng = np.random.default_rng(4)
    for n in (0, 1, 95, 96, 97, 143, 144, 145, 500):
        text = "".join("x1 @"[k] for k in rng.choice(4, n, p=[0.9, 0.04, 0.04, 0.02]))
        last = max(0, -(-(n - pii.WINDOW) // pii.STRIDE)) * pii.STRIDE
        grid = [s for s in range(0, last + 1, pii.STRIDE) if pii.TRIGGER.search(text[s:s + pii.WINDOW])]
        assert pii.windows_of(text) == grid


def test_reconcile_joins_cut_pieces_and_settles_conflicts():
    text = "x " * 10 + "(213) 555-5044" + " y" * 20
    assert pii.reconcile(text, [(20, 28, 3, 2.0, False, True), (24, 34, 3, 3.0, True, False)], []) == [(20, 3, 34)]
    # two readings of the same place: the one with the larger total lead
    assert pii.reconcile(text, [(20, 34, 3, 2.0, False, False), (26, 34, 3, 9.0, False, False)], []) == [(20, 3, 34)]
    # a base span is never overlapped; a span that fails its check is dropped
    assert pii.reconcile(text, [(20, 34, 3, 2.0, False, False)], [(25, 2, 34)]) == []
    assert pii.reconcile("on 2023-11-04 at", [(3, 13, 3, 5.0, False, False)], []) == []


def test_model_adds_variants_and_leaves_prose(model):
    rng = np.random.default_rng(8)
    found = wanted = 0
    for k in range(300):
        kind, item = pii._written(rng, PROSE[k % 3].split())
        left = PROSE[k % 3][:20 + k % 50] + " "
        text = left * (1 + k % 4) + item + " " + PROSE[(k + 1) % 3]
        base = pii.base_spans(text)
        added = pii.added_spans([text], [base], model)[0]
        if kind >= 0 and not base:
            wanted += 1
            found += any(a[0] < text.index(item) + len(item) and a[2] > text.index(item) for a in added)
    assert wanted > 40 and found >= 0.8 * wanted
    clean = [" ".join(PROSE) * 3, "In 1999 (page 12) it cost $4.50, 30% more; see 2023-11-04, 12:45 and version 1.2.3.", ""]
    assert pii.added_spans(clean, [pii.base_spans(t) for t in clean], model) == [[], [], []]


def test_span_across_many_windows(model):
    name, host = "a" * 60, "b" * 60
    text = " ".join(PROSE) + f" {name}@{host}.example.com " + " ".join(PROSE)
    (start, kind, end), = pii.base_spans(text)
    assert text[start:end] == f"{name}@{host}.example.com" and kind == 0
    assert all(s[2] <= start or s[0] >= end for s in pii.added_spans([text], [pii.base_spans(text)], model)[0])


def test_edge_table(edge, none, model):
    out = pii.personal_data(edge, model).select("doc_id", *pii.digest())
    rows = out.collect()
    assert len(rows) == edge.count()
    assert all(r.n_email == r.n_ip == r.n_card == r.n_phone == 0 and r.spans == "" for r in rows)
    assert rows[0].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert pii.personal_data(none, model).count() == 0
    long = edge.sparkSession.createDataFrame([(1, "é𝄞 " * 40_000 + "mail x.y@z.org or +1 213 555 5044" + " z" * 50)], "doc_id long, text string")
    r = pii.personal_data(long.withColumn("spans", F.lit(1)), model).select("doc_id", *pii.digest()).first()
    assert r.spans == "email:120005:120014,phone:120018:120033" and (r.n_email, r.n_phone) == (1, 1)


def test_training_from_a_table(spark):
    rows = [(k, f"{PROSE[k % 3]} call +1 (213) 555-{1000 + k} or mail ab{k}@host{k % 7}.org now") for k in range(60)]
    rows += [(100 + k, PROSE[k % 3] * 3) for k in range(30)] + [(None, None), (7, None), (7, "")]
    m = pii.train(spark.createDataFrame(rows, "doc_id long, text string"), steps=3)
    again = pii.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), steps=3)
    assert all(np.allclose(m.p[k], again.p[k], atol=1e-5) for k in m.p)  # reruns learn from the same rows
    assert classes("aé\n").tolist() == [66, 97, 96]
