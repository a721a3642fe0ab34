"""Toxicity by weak supervision (operator 2).

Many weak voters look at a text and vote toxic, clean, or not at all:

* fixed lexicons and patterns vote toxic where they fire and abstain elsewhere;
* mined lexicons: discriminative words and word beginnings of the labelled sample,
  dealt out to ``MINED_VOTERS`` voters. Each compares how often
  its features occur with the rates of both classes (a Poisson test): it votes toxic
  or clean where the odds reach ``VOTE`` to 1, and abstains on the rest, such as
  short texts.

A generative label model, fitted by expectation maximisation on the votes alone,
estimates how often each voter that votes is right in each class, and how strongly
voters stay correlated once the class is known; correlated voters share their
weight, and voters that never vote take no part. Labels set the prior and say which
class is which; they are no votes. The model's posterior labels train a linear
classifier over the features and the voters, and that classifier scores texts.

Fitting uses a bounded sample of labelled rows: ``2 * per_class`` documents of each
class at most, in the order of their id's hash; ``FEATURES`` features at most are
kept. Scoring reads every whole text in a map-only pass; what is broadcast is the
classifier.

Defined results: a null text counts as empty; an empty text gets the score of a
text in which no voter votes; without labelled rows of both classes every score
is 0; repeated rows get the same score each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, fit_logistic, fold, labelled_sample, map_text, sigmoid, table
from storelens.llm.textops import U, Words, mix

FEATURES = 200          #: mined features of the classifier at most
MINED_VOTERS = 12       #: voters that share the mined features
VOTE = 3.0              #: odds from which a mined voter votes
BEGINNINGS = (4, 5, 6)  #: lengths in bytes of the word beginnings used as features

#: Lexicons, one voter each.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid imbecile fool dumb dumbass loser losers clown jerk",
    "contempt": "worthless pathetic disgusting trash garbage scum vermin filth filthy useless",
    "threat": "kill die hang shoot burn destroy hurt rape",
    "french": "imbécile connard connasse salaud salope abruti crétin débile ordure merde",
    "german": "arschloch trottel schwachkopf dummkopf abschaum widerlich wertlos scheisse scheiße hurensohn",
    "spanish": "idiota imbécil estúpido estúpida basura asqueroso inútil escoria mierda pendejo cabrón",
}
#: Patterns, one voter each, with strings of which a match holds at least one.
PATTERNS = {
    "address": (r"\byou(?:'re| are)? (?:an? |such an? |all )?(?:\w+ )?(?:idiot|moron|loser|scum|trash|clown)s?\b", ("you",)),
    "command": (r"\b(?:shut up|get lost|go to hell|drop dead|kill yourself)\b",
                ("shut up", "get lost", "go to hell", "drop dead", "kill yourself")),
    "masked": (r"[a-z](?:\*{2,}|@{2,}|#{2,}|\${2,})[a-z]", ("**", "@@", "##", "$$")),
    "pileup": (r"!{4,}|\?!\?!", ("!!!!", "?!?!")),
}


def _word_hash(words: str) -> np.ndarray:
    w = Words(words.lower().encode("utf-8"), letters=True)
    return mix(w.hashes() + U(1)) >> U(16)


_LEX = {name: np.unique(_word_hash(words)).astype(np.int64) for name, words in LEXICONS.items()}
_PAT = [(re.compile(p), needs) for p, needs in PATTERNS.values()]
FIXED = len(_LEX) + len(_PAT)


def raw_features(text: str) -> tuple[np.ndarray, int]:
    """48-bit hashes of the words and word beginnings of a lower-cased text, with repeats; the number of words."""
    w = Words(text.encode("utf-8", "surrogatepass"), letters=True)
    size = w.end - w.start
    found = [mix(w.hashes() + U(1))]
    for n in BEGINNINGS:
        long = w.start[size > n]
        found.append(mix(w.substring(long, long + n) + U(n)))
    return (np.concatenate(found) >> U(16)).astype(np.int64), len(size)


def features(text: str | None) -> np.ndarray:
    """Distinct 48-bit hashes of the text's words and word beginnings."""
    return np.unique(raw_features(text.lower())[0]) if text else np.zeros(0, np.int64)


def fixed_votes(lower: str, near: np.ndarray) -> list[bool]:
    """Which lexicons and patterns fire; ``near``: features of the text, those of the lexicons among them."""
    lex = [bool(len(near)) and bool(np.isin(v, near).any()) for v in _LEX.values()]
    return lex + [any(n in lower for n in needs) and p.search(lower) is not None for p, needs in _PAT]


def label_model(votes: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior probability of class 1 from votes (1, 0: none, -1), with the voters' accuracies and correlations.

    Two classes; voter j, where it votes, says 1 with rate[c, j] in class c;
    abstaining says nothing. A first fit takes the voters as independent; its
    residual correlations divide a voter's weight by the number of voters that it
    effectively repeats, and a second fit uses these weights. Both start from the
    majority of the votes.
    """
    lead = votes.sum(1)
    start = np.where(lead > 0, 0.9, np.where(lead < 0, prior / 5, prior))
    yes, cast = (votes > 0).astype(float), (votes != 0).astype(float)

    def rates(post):
        weight = np.stack([1 - post, post])
        return weight, (weight @ yes + 0.5) / (weight @ cast + 1.0)

    def fit(share):
        post = start
        for _ in range(rounds):
            _, rate = rates(post)
            fire = share * (np.log(rate[1]) - np.log(rate[0]))
            quiet = share * (np.log1p(-rate[1]) - np.log1p(-rate[0]))
            new = sigmoid(np.log(prior / (1 - prior)) + yes @ fire + (cast - yes) @ quiet)
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break
        return post

    weight, rate = rates(fit(cast.any(0).astype(float)))
    rest = (yes - weight.T @ rate) * cast
    std = np.sqrt((rest ** 2).mean(0)) + 1e-9
    corr = (rest.T @ rest) / len(votes) / np.outer(std, std)
    share = cast.any(0) / np.clip(corr, 0, 1).sum(0).clip(1)
    post = fit(share)
    return post, {"rate": rates(post)[1], "correlation": corr, "share": share}


@dataclass
class ToxicityModel:
    keys: np.ndarray     # sorted feature hashes
    voter: np.ndarray    # the mined voter of each feature
    odds: np.ndarray     # per voter: log of the rate of its features in toxic text over that in clean text
    excess: np.ndarray   # per voter: difference of the two rates, per word
    weights: np.ndarray  # of row()

    def __post_init__(self):
        self._slot = None

    def __getstate__(self):
        return {**self.__dict__, "_slot": None}

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(the classifier's inputs: features, evidence and votes of the voters; the votes)."""
        x = np.zeros(len(self.keys) + 2 * MINED_VOTERS + FIXED + 1)
        if not text:
            return x, np.zeros(MINED_VOTERS + FIXED)
        if self._slot is None:
            self._slot = np.zeros(1 << 20, bool)
            for k in (self.keys, *_LEX.values()):
                self._slot[k & 0xFFFFF] = True
        lower = text.lower()
        raw, words = raw_features(lower)
        near = raw[self._slot[raw & 0xFFFFF]]
        hits = np.zeros(MINED_VOTERS)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
            at = at[self.keys[at] == near]
            x[at] = 1
            hits = np.bincount(self.voter[at], minlength=MINED_VOTERS)
        evidence = hits * self.odds - words * self.excess
        mined = np.sign(evidence) * (np.abs(evidence) > np.log(VOTE))
        votes = np.concatenate((mined, fixed_votes(lower, np.unique(near))))
        x[len(self.keys):] = np.concatenate((np.clip(evidence, -8, 8) / 4, votes, [np.clip(evidence.sum(), -30, 30) / 10]))
        return x, votes

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.row(text)[0] @ self.weights[:-1] + self.weights[-1]))


def _mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discriminative features of the sample, strongest first, and their occurrences per word of clean and of toxic text.

    Counted where the texts are: each batch sends one row per distinct feature.
    """
    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = [raw_features((t.as_py() or "").lower()) for t in b.column(0)]
            toxic = np.array(b.column(1).to_pylist()) == 1
            words = np.array([n for _, n in raw])
            size = [len(f) for f, _ in raw]
            flat, doc = np.concatenate([f for f, _ in raw]), np.repeat(np.arange(len(raw)), size)
            key, back = np.unique(flat, return_inverse=True)
            once = np.unique(back * len(raw) + doc)  # each feature of a text once
            per = lambda at, flag: np.bincount(at, flag, len(key)).astype(np.int64)
            cols = [per(once // len(raw), toxic[once % len(raw)]), per(once // len(raw), ~toxic[once % len(raw)]),
                    per(back, toxic[doc]), per(back, ~toxic[doc])]
            # key -1: the words of all texts
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(key, -1))] + [pa.array(np.append(c, v)) for c, v in
                                                  zip(cols, (0, 0, words[toxic].sum(), words[~toxic].sum()), strict=True)],
                ["key", "tox", "clean", "tox_n", "clean_n"])

    size = {r.cls: r.n for r in sample.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = max(3, size.get(1, 0) // 300)
    odds = F.log((F.col("tox") + 0.5) / (size.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (size.get(0, 0) + 1))
    every = (sample.select("text", "cls").mapInArrow(count, "key long, tox long, clean long, tox_n long, clean_n long")
             .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tox", "clean", "tox_n", "clean_n")]))
    every = checkpointed(every.where(f"tox >= {least} or key = -1"))
    words = every.where("key = -1").first()
    rows = (every.where("key <> -1").withColumn("odds", odds).where("odds > 1.5")
            .orderBy((F.col("odds") * F.sqrt("tox")).desc(), "key").limit(FEATURES).collect())
    per = np.array([words.clean_n, words.tox_n], float).clip(1) if words else np.ones(2)
    return np.array([r.key for r in rows], np.int64), np.array([[r.clean_n, r.tox_n] for r in rows]).reshape(-1, 2), per


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> ToxicityModel | None:
    """Fit on labelled rows outside the held-out fold (crc32 of the id mod 5 = 0)."""
    known = labels.where(fold("doc_id", 5) > 0).where("toxic in (0, 1)")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    prior = counts[1] / (counts[0] + counts[1])
    both = labelled_sample(docs, known, F.col("toxic"), 2 * per_class)
    sample = checkpointed(both.dropDuplicates(["text", "cls"]))  # copies teach nothing new
    keys, seen, words = _mine(sample)
    voter = np.arange(len(keys)) % MINED_VOTERS  # dealt out strongest first
    rate = np.stack([np.bincount(voter, seen[:, c], MINED_VOTERS) + 0.5 for c in (0, 1)]) / words[:, None]
    order = np.argsort(keys)
    inputs = len(keys) + 2 * MINED_VOTERS + FIXED + 1
    model = ToxicityModel(keys[order], voter[order], np.log(rate[1] / rate[0]), rate[1] - rate[0], np.zeros(inputs + 1))

    def rows(texts: pa.Array) -> list:
        got = [model.row(t.as_py()) for t in texts]
        return [pa.array([x.astype(np.float32).tobytes() for x, _ in got], pa.binary()),
                pa.array([v.astype(np.int8).tobytes() for _, v in got], pa.binary())]

    got = map_text(sample, "x binary, v binary", rows, ["cls", "_id"]).collect()  # 2 * per_class rows a class
    got.sort(key=lambda r: (r._id, r.cls))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    votes = np.stack([np.frombuffer(r.v, np.int8) for r in got]).astype(float)
    share = min(max(np.mean([r.cls for r in got]), 1e-3), 1 - 1e-3)  # the sample's prior
    post, _ = label_model(votes, share)
    # from the sample's balance of the classes to that of all labels: a text without votes gets the prior, not a half
    toxic, clean = post * prior / share, (1 - post) * (1 - prior) / (1 - share)
    model.weights = fit_logistic(x, toxic / (toxic + clean), toxic + clean, l2=1.0, steps=30)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, keep: list[str]) -> DataFrame:
    """``keep`` plus score; a map-only pass over whole texts."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: pa.Array) -> list:
        m = shared.value
        return [pa.array([m.score(t.as_py()) for t in texts], pa.float64())]

    return map_text(docs, "score double", fn, keep)


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is 0.5 or more go; learned from ``labels``."""
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    return score_toxicity(docs, model, cols).where("score < 0.5").select(*cols)
