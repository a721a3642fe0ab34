"""Operator 4 against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from storelens.llm import spm_codec


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm_codec.default_model())


def test_random_texts(library):
    ours = spm_codec.PrefixTableBPE(spm_codec.default_model(), memo_size=50)
    rnd = random.Random(3)
    bits = list("abcdefghij \n\t.,;'\"0123ABCé漢字▁\u0000𝄞€") + ["  ", "▁▁", "the", "ing", "</s>", "<0x0A>", "\r\n", " t", "er"]
    pieces = [p.replace("▁", " ") for p in ours.ids]
    for k in range(3000):
        t = "".join(rnd.choice(bits if k % 2 else pieces) for _ in range(rnd.randint(0, 25)))
        ids = library.encode(t, add_eos=True)
        assert ours.encode(t) == ids, t
        assert ours.decode(ids) == library.decode(ids)


def test_long_part_without_spaces(library):
    t = "ab漢c" * 5000
    assert spm_codec.codec(spm_codec.default_model()).encode(t) == library.encode(t, add_eos=True)


def test_query_rows(edge, none, library):
    rows = {r.doc_id: r for r in spm_codec.spm_digest(edge).collect()}
    for r in edge.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert spm_codec.spm_digest(none).count() == 0
    assert spm_codec.spm_encode(edge).where("doc_id = 4").first().ids == library.encode("one", add_eos=True)
