"""Language identification in two levels (operator 5).

First the language family is predicted (one linear support vector machine per
family against the rest), then one-versus-one linear support vector machines
separate the languages of that family. Features are hashed counts of the one to
three letter sequences of the lower-cased text, square-rooted and scaled to
length 1.

Fitting uses a bounded sample: ``per_class`` documents of each language in the
order of their id's hash. Scoring reads every whole text in a map-only pass.

Defined results: ``und`` with score 0 for a null text or one without a letter,
and for every text if no language could be learned; repeated rows get the same
answer; ties go to the language first in code point order.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import fold, labelled_sample, map_text, sigmoid, table

DIMS = 4096
UNKNOWN = "und"

#: Language families by ISO 639-1 code. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt uz",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0] in codes.split()), lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all code points."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str | None) -> np.ndarray | None:
    """Hashed letter sequences of one text; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    gap = c == 32
    c = c[~(gap & np.concatenate(([False], gap[:-1])))]  # one space between words
    a = c * np.uint64(0x9E3779B97F4A7C15)
    b = a[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:] * np.uint64(0x165667B19E3779F9)
    t = b[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x85EBCA77C2B2AE63)
    shift = np.uint64(52)  # the top 12 bits: DIMS values
    n = sum(np.bincount((x ^ (x << np.uint64(23))) >> shift, minlength=DIMS) for x in (a, b, t))
    v = np.sqrt(n.astype(np.float32))
    return v / np.float32(np.linalg.norm(v))


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Squared-hinge linear SVM (weights, then the offset) by accelerated gradient steps; y in {-1, 1}.

    Both classes weigh the same in the loss.
    """
    f = np.float32
    x = np.hstack([x, np.ones((len(x), 1), f)])
    s = (np.where(y > 0, 1.0 / max((y > 0).sum(), 1), 1.0 / max((y < 0).sum(), 1)) * cost).astype(f)
    y = y.astype(f)
    w = np.zeros(x.shape[1], f)
    look, t = w, 1.0
    v = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), f)
    for _ in range(15):  # the largest curvature
        v = x.T @ (s * (x @ v))
        v /= np.linalg.norm(v)
    rate = f(1.0 / (1.0 + 1.05 * float(np.linalg.norm(x.T @ (s * (x @ v))))))
    for _ in range(steps):
        slack = np.maximum(f(0), f(1) - y * (x @ look))
        grad = look - x.T @ (s * y * slack)
        new = look - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + f((t - 1) / t2) * (new - w), new, t2
    return w


class LanguageModel:
    """Family machines and, inside each family, one machine per pair of languages."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        langs = sorted(set(lang))
        fam = np.array([family(v) for v in lang])
        self.members = {f: [v for v in langs if family(v) == f] for f in sorted(set(fam))}
        self.families = list(self.members)
        self.top = np.stack([train_svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families]) \
            if len(self.families) > 1 else np.zeros((1, DIMS + 1), np.float32)
        self.pairs = {}
        for f, names in self.members.items():
            for a, b in combinations(names, 2):
                at = (lang == a) | (lang == b)
                self.pairs[a, b] = train_svm(x[at], np.where(lang[at] == a, 1.0, -1.0))

    def predict(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None:
            return UNKNOWN, 0.0
        margin = self.top[:, :-1] @ v + self.top[:, -1]
        k = int(margin.argmax())
        names = self.members[self.families[k]]
        score = 1.0
        if len(self.families) > 1:
            p = sigmoid(2.0 * margin)
            score = float(p[k] / p.sum())
        if len(names) == 1:
            return names[0], score
        wins = dict.fromkeys(names, 0.0)
        chance = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            w = self.pairs[a, b]
            m = float(w[:-1] @ v + w[-1])
            p = float(sigmoid(2.0 * m))
            wins[a if m >= 0 else b] += 1
            chance[a] += p
            chance[b] += 1 - p
        best = max(names, key=lambda n: (wins[n], chance[n]))
        return best, score * chance[best] / (len(names) - 1)


FIT_ROWS = 8000  #: documents (16 KB of features each) that the machines are fitted on at most


def learn_languages(docs: DataFrame, per_class: int = 600) -> LanguageModel | None:
    """Fit on documents whose crc32 of the id mod 4 is not 2 and whose lang is not null.

    ``FIT_ROWS`` documents in all at most: ``per_class`` a language, fewer where there
    are many; of more than ``FIT_ROWS`` lang values the most frequent are learned.
    """
    known = docs.where((fold("doc_id", 4) != 2) & (fold("doc_id", 4) >= 0)).where("lang is not null")
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = langs.count()
    if found > FIT_ROWS:
        top = langs.orderBy(F.desc("n"), "lang").limit(FIT_ROWS).select("lang")
        known = known.join(top, "lang", "left_semi")
    sample = labelled_sample(docs, known, F.col("lang"), max(1, min(per_class, FIT_ROWS // max(found, 1))))

    def fn(texts: pa.Array) -> list:
        got = [features(t.as_py()) for t in texts]
        return [pa.array([None if v is None else v.tobytes() for v in got], pa.binary())]

    rows = map_text(sample, "v binary", fn, ["cls", "_id"]).where("v is not null").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.cls, r._id))
    x = np.stack([np.frombuffer(r.v, np.float32) for r in rows])
    return LanguageModel(x, np.array([r.cls for r in rows]))


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """``keep`` plus lang_pred and score; a map-only pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: pa.Array) -> list:
        m = shared.value
        got = [(UNKNOWN, 0.0) if m is None else m.predict(features(t.as_py())) for t in texts]
        return [pa.array([g[0] for g in got], pa.string()),
                pa.array([min(1.0, max(0.0, float(g[1]))) for g in got], pa.float64())]

    return map_text(docs, "lang_pred string, score double", fn, keep)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn_languages(docs), ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
