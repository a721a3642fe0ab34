"""The pipeline's stages one by one against plain checks, and the operators' plans."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
import corpus_pipeline
from storelens.llm import fingerprint, mixing, registry, secrets
from storelens.session import plan_text

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in registry.QUERIES}
    assert set(registry.QUERIES) | {"pipeline"} <= names


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "sentencepiece"]
    assert all(d.columns == COLS for d in kept[:-1])
    size = [d.count() for d in kept]
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert whole.count() > size[0] > size[1] == size[2] and size[3] == size[4]
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").join(whole, "doc_id")
    assert kept[0].join(toxic, "doc_id").count() < 0.4 * toxic.count()
    text = {r.doc_id: r.text for r in whole.collect()}
    for r in kept[2].collect():
        assert not re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text)
        if "[SECRET]" not in r.text:
            assert r.text == text[r.doc_id]
    assert kept[4].where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == size[-1]


@pytest.mark.parametrize("query", [mixing.op3_entropy_mix, secrets.op6_secret_links, fingerprint.op7_oph_fingerprint])
def test_native_plans_hold_no_python(spark, query):
    plan = plan_text(query(spark, SF))
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark, none, save):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    folder = save(documents=none, labels=labels, embeddings=vectors)
    for name, query in registry.QUERIES.items():
        assert query(spark, folder).count() == 0, name


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_dedup_stage_by_row(spark):
    from storelens.llm.ngram_join import dedup_stage
    long = " ".join(f"w{k}" for k in range(60))
    near = long + " x1"
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(3, long, "a"), (2, near, "a"), (None, long, "a"),          # one group: id 2 stays
            (7, other, "a"), (7, "quite another text of its own here today", "a"),  # different texts under one id: both stay
            (None, "no id and no copy of anything in this table", "a"), (None, "no id and no copy of anything in this table", "a"),
            (9, "", "a"), (9, "", "a"), (10, None, "a"), (5, near + " y z", "b")]
    got = sorted((str(r.doc_id), r.text) for r in dedup_stage(spark, _docs(spark, rows), "").collect())
    assert got == sorted([("2", near), ("7", other), ("7", rows[4][1]), ("None", rows[5][1]), ("9", ""), ("9", ""), ("10", None)])
    again = dedup_stage(spark, _docs(spark, rows[::-1]).repartition(3), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in again) == got


def test_mixing_stage_shares_copies_of_equal_rows(spark):
    from storelens.llm.mixing import mix, mixing_stage
    rows = [(1, "one two three four", "hot")] * 400 + [(k, f"a{k} b c d e", "hot") for k in range(2, 60)] + [
        (k, "x y z " * (k % 5 + 1), "small") for k in range(60, 90)] + [(None, None, "small")]
    docs = _docs(spark, rows)
    plan = {r.source: r.taken for r in mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    kept = mixing_stage(spark, docs, "").collect()
    for source in ("hot", "small"):
        assert sum(len(r.text.split()) for r in kept if r.source == source) == plan[source]
    target = mix(docs).where("source = 'hot'").first().target
    assert abs(plan["hot"] - target) <= 5


def test_stages_on_edge_rows(spark, edge, none, save):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 11)], "doc_id long, quality int, toxic int")
    folder = save(documents=edge, labels=labels)
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert name == "sentencepiece" or docs.columns == COLS, name
    rows = docs.collect()
    assert all(r.round_trip for r in rows)
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, save(documents=none, labels=labels.where("false")))
    assert empty.count() == 0
