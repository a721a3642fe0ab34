"""Operator 7: edited texts exactly, likeness against the exact Jaccard similarity."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from storelens.llm import fingerprint

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprint.op7_oph_fingerprint(spark, SF).collect()}
    assert len(got) == len(docs)
    err, next_err = [], []
    for k, r in enumerate(docs):
        following, g = docs[(k + 1) % len(docs)], got[r.doc_id]
        cut = len(r.text) // 3
        edited = r.text[:len(r.text) - cut] + following.text[:cut]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(g.fingerprint) == fingerprint.BINS * fingerprint.BITS // 4
        err.append(g.near_edited - jaccard(r.text, edited))
        next_err.append(g.near_next - jaccard(r.text, following.text))
    assert abs(np.mean(err)) < 0.015 and np.std(err) < 0.045
    assert np.std(next_err) < 0.03


def test_estimate_is_unbiased_over_similarities(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(s, " ".join(words[:300]), " ".join(words[s:300 + s])) for s in range(0, 100, 4)]
    df = spark.createDataFrame(rows, "s int, x string, y string")
    df = fingerprint.with_digits(fingerprint.with_digits(df, "x", "dx"), "y", "dy")
    got = df.select("x", "y", fingerprint.likeness(F.col("dx"), F.col("dy")).alias("j")).collect()
    err = [r.j - jaccard(r.x, r.y) for r in got]
    assert abs(np.mean(err)) < 0.03 and np.max(np.abs(err)) < 0.13


def test_edges(spark, edge, none, save):
    rows = fingerprint.op7_oph_fingerprint(spark, save(documents=edge)).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "" and by[1].n_chars == 0
    assert by[6].fingerprint == by[7].fingerprint and by[7].near_next == 1.0
    assert by[3].near_next == 1.0 and by[4].near_next == 0.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    # the row without an id comes last, so the first in order follows it
    text, first = (edge.where(c).first().text for c in ("doc_id is null", "doc_id = 10"))
    edited = text[:len(text) - len(text) // 3] + first[:len(text) // 3]
    assert by[None].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_empty_and_single(spark, none, save):
    assert fingerprint.op7_oph_fingerprint(spark, save(documents=none)).count() == 0
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    r = fingerprint.op7_oph_fingerprint(spark, save(documents=one)).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_one_id_many_rows(spark):
    rows = [(5, f"text {k}") for k in range(300)] + [(k + 10, f"other {k}") for k in range(20)] + [(1, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    got = fingerprint.with_next(df, ["text"]).collect()
    assert len(got) == len(rows) and all(r.next_text is not None for r in got)
    assert len({r.next_text for r in got}) == len(rows)  # every row follows exactly one other
