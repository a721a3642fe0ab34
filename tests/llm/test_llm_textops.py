"""Vectorised hashing against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from storelens.llm import textops

TEXTS = [None, "", " \t", "one", "One two", "a b c d e", "A  B\tC\nD\x0bE\x0cF\rg", "é É x y z w", "x" * 70_000,
         "same same same same same same same", "\x1f \x1c\x1d"] + [" ".join(random.Random(k).choices("abcde", k=k)) for k in range(40)]


def words(t):
    return [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]


def test_words_are_the_contracts_words():
    seen = {}
    for t in TEXTS:
        got = textops.lower_words(t)
        assert len(got) == len(words(t))
        for w, h in zip(words(t), got.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    back = {}
    for t in TEXTS:
        w = words(t)
        want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        got = textops.shingle_set(t)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        key = frozenset(got.tolist())
        assert back.setdefault(key, want) == want


def test_many_texts_at_once_give_the_same():
    w, count = textops.group_words(TEXTS)
    assert (w == np.concatenate([textops.lower_words(t) for t in TEXTS])).all()
    assert count.tolist() == [len(textops.lower_words(t)) for t in TEXTS]
    for t, s in zip(TEXTS, textops.group_shingles(TEXTS)):
        assert (s == textops.shingle_set(t)).all() and len(s) == len(textops.shingle_set(t))


def test_groups_keep_every_text():
    arr = pa.array(TEXTS)
    got = list(textops.text_groups(arr, 50))
    assert [t for _, ts in got for t in ts] == TEXTS and got[0][0] == 0
    assert all(TEXTS[first] == ts[0] for first, ts in got)
