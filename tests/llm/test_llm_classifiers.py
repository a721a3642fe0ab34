"""Operators 1, 2 and 5: held-out accuracy, and defined results for odd input."""

from __future__ import annotations

import numpy as np
import pytest

from storelens.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def _auc(y, p):
    order = np.argsort(np.argsort(p, kind="stable")) + 1
    pos = (y == 1).sum()
    return (order[y == 1].sum() - pos * (pos + 1) / 2) / max(pos * (len(y) - pos), 1)


@pytest.mark.parametrize("query, label, least", [(quality.op1_compression_quality, "quality", 0.95),
                                                 (toxicity.op2_weak_toxicity, "toxic", 0.85)])
def test_held_out_scores(spark, query, label, least):
    found = query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == docs.count()
    held = found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert _auc(held[label].to_numpy(), held.score.to_numpy()) > least
    assert held.score.between(0, 1).all()


def test_language_held_out(spark):
    found = langid.op5_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_edge_rows(spark, edge):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 11)] + [(None, 1, 1), (99, None, None)],
                                   "doc_id long, quality int, toxic int")
    q = quality.score_quality(edge, quality.learn_quality(edge, labels), ["doc_id"]).toPandas()
    t = toxicity.score_toxicity(edge, toxicity.learn_toxicity(edge, labels), ["doc_id"]).toPandas()
    v = langid.identify(edge, langid.learn_languages(edge), ["doc_id"]).toPandas()
    assert len(q) == len(t) == len(v) == edge.count()
    assert q.score.between(0, 1).all() and t.score.between(0, 1).all() and v.score.between(0, 1).all()
    und = set(v[v.lang_pred == "und"].doc_id.dropna())
    assert und == {1, 2, 3}
    assert q[q.doc_id == 1].score.item() == q[q.doc_id == 2].score.item()


def test_sample_counts_ids_not_rows(spark):
    from pyspark.sql import functions as F

    from storelens.llm.common import labelled_sample
    ids = spark.range(4000)
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("again "), "id").alias("text")))
    labels = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(1).alias("quality")))
    got = labelled_sample(docs, labels, F.col("quality"), 200).collect()
    assert len({r._id for r in got}) == len(got) == 400 and sum(r.cls for r in got) == 200
    # reruns, also over other partitions, take the same rows
    again = labelled_sample(docs.repartition(7), labels.repartition(5), F.col("quality"), 200).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    few = labelled_sample(docs, labels.where("doc_id < 6"), F.col("quality"), 200).collect()
    assert sorted(r._id for r in few) == [0, 1, 2, 3, 4, 5]


def test_many_languages_fit_in_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_ROWS", 40)
    rows = [(k, f"wort{k % 100} und noch ein satz {chr(97 + k % 26) * 5}", f"l{k % 100}") for k in range(2000)]
    model = langid.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 0 < sum(map(len, model.members.values())) <= 40


def test_nothing_to_learn(spark, edge, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn_quality(edge, labels) is None and toxicity.learn_toxicity(edge, labels) is None
    assert set(r.score for r in quality.score_quality(edge, None, ["doc_id"]).collect()) == {0.5}
    assert set(r.score for r in toxicity.score_toxicity(edge, None, ["doc_id"]).collect()) == {0.0}
    assert langid.learn_languages(none) is None
    assert set(r.lang_pred for r in langid.identify(edge, None, ["doc_id"]).collect()) == {"und"}
    assert quality.score_quality(none, None, ["doc_id"]).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    """From votes alone: accuracies, a repeated voter, a voter that never votes; half of the votes are missing."""
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3

    def vote(hit, false):
        v = np.where(np.where(y, rng.random(4000) < hit, rng.random(4000) < false), 1, -1)
        return v * (rng.random(4000) < 0.5)
    a, b, c, d = vote(0.9, 0.05), vote(0.8, 0.1), vote(0.5, 0.5), vote(0.85, 0.1)
    votes = np.stack([a, b, c, a, 0 * a, d, vote(0.9, 0.1)], 1).astype(float)
    post, got = toxicity.label_model(votes, 0.3)
    assert abs(got["rate"][1][0] - 0.9) < 0.06 and abs(got["rate"][0][0] - 0.05) < 0.06
    assert abs(got["rate"][1][2] - got["rate"][0][2]) < 0.1  # the coin is seen through
    assert got["correlation"][0, 3] > 0.9 and got["share"][0] < 0.6 < got["share"][1] and got["share"][4] == 0
    assert ((post > 0.5) == y).mean() > 0.88
    assert np.allclose(toxicity.label_model(np.zeros((5, 3)), 0.2)[0], 0.2)


def test_labels_are_no_votes(spark):
    """Most mislabelled texts are put right by their votes; their labels do not reach the label model."""
    rng = np.random.default_rng(2)
    words = [f"wort{k}" for k in range(200)]
    bad = "grobian schuft lump ekel flegel wicht rüpel strolch biest schurke gauner widerling".split()
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        text = " ".join([*rng.choice(words, 60), *(rng.choice(bad, 5) if toxic else [])])
        rows.append((k, text, int(toxic)))
    wrong = [r[0] for r in rows if r[0] % 40 == 0]  # a tenth of the toxic texts is labelled clean
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0 if d in wrong else t) for d, _, t in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    # a sample of equal classes: texts without votes still get the prior of all labels
    even = toxicity.learn_toxicity(docs, labels, per_class=30)
    assert even.score("") < 0.4 and even.score("wort1 wort2") < 0.5
    assert sum(score[d] > 0.5 for d in wrong) >= 0.8 * len(wrong) and sum(score[d] > 0.5 for d, *_ in rows) <= 105


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w = langid.train_svm(x, y, cost=100.0)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97
