"""Compression classifier for text quality (operator 1).

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A text is cut into blocks; every block is compressed with both, and the
normalised difference of the summed sizes, (bad - good) / (bad + good), becomes
a score by a logistic calibration on labelled documents that are in neither
dictionary. The calibration also sees the size with the good dictionary per
byte of text: in text that repeats itself both sizes are tiny and their
difference says little.

Only a bounded sample of labelled rows is used for fitting: ``per_class``
documents per class in the order of their id's hash, and of each at most
``BLOCKS_PER_DOC`` evenly spread blocks enter a dictionary. Scoring reads every
whole text in a map-only pass; what is broadcast is two dictionaries of at most
``DICT_BYTES`` and two numbers.

Defined results: a null text counts as empty; an empty text has difference 0
and the mean size per byte, thus the score of a text that neither dictionary favours;
without labelled rows of both classes every score is 0.5; repeated rows get
the same score each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, fit_logistic, fold, labelled_sample, map_text, sigmoid, table

BLOCK = 2048            #: bytes compressed at once, so that the dictionary and not the text's own past decides
BLOCKS_PER_DOC = 8      #: blocks of one document in a dictionary at most
DICT_BYTES = 112_640    #: size of each dictionary at most
LEVEL = 3


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    if sum(map(len, samples)) >= 8 * 4096 and len(samples) >= 8:
        size = min(DICT_BYTES, sum(map(len, samples)) // 8)
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICT_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False,
                                                            write_dict_id=False)
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8")
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    weights: np.ndarray | None = None  # of the scaled measures, then the offset
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def measures(self, text: str | None) -> list[float] | None:
        """Normalised size difference, and the logarithm of the size per byte with its square."""
        if not text:
            return None
        if self._pair is None:
            self._pair = _compressor(self.good).compress, _compressor(self.bad).compress
        good, bad = self._pair
        g = b = n = 0
        for x in blocks(text):
            g += len(good(x))
            b += len(bad(x))
            n += len(x)
        r = float(np.log(g / (n + 32)))  # frames have some bytes of their own
        return [(b - g) / (b + g), r, r * r]

    def score(self, text: str | None) -> float:
        m = self.measures(text)
        z = np.zeros(3) if m is None else (np.array(m) - self.mean) / self.scale
        if m is None:
            z[0] = -self.mean[0] / self.scale[0]
        return float(sigmoid(z @ self.weights[:-1] + self.weights[-1]))


def fit(sample: DataFrame, share: dict[int, float]) -> CompressionModel | None:
    """Dictionaries from one half of the sample (by hash), calibration on the other.

    ``sample``: (_h, _id, text, cls) as from labelled_sample; ``share``: the
    classes' weights in the whole labelled set, so that scores are calibrated.
    """
    picked = F.expr(f"slice(transform(sequence(0, {BLOCKS_PER_DOC - 1}), i -> substring(text, "
                    f"cast(1 + i * greatest(length(text) div {BLOCKS_PER_DOC}, {BLOCK}) as int), {BLOCK})), 1, "
                    f"cast(least({BLOCKS_PER_DOC}, ceil(length(text) / {BLOCK})) as int))")
    rows = sample.where("_h % 2 = 0 and length(text) > 0").select("cls", picked.alias("b"), "_h").collect()
    rows.sort(key=lambda r: r._h)
    made = {c: build_dictionary([x.encode("utf-8")[:BLOCK] for r in rows if r.cls == c for x in r.b if x])
            for c in (0, 1)}
    if not (made[0] and made[1]):
        return None
    model = CompressionModel(made[1], made[0])

    def measured(texts: pa.Array) -> list:
        return [pa.array([model.measures(t) for t in texts.to_pylist()], pa.list_(pa.float64()))]

    held = (map_text(sample.where("_h % 2 != 0"), "x array<double>", measured, ["cls", "_id"])
            .where("x is not null").collect())
    held.sort(key=lambda r: (r.cls, r._id))
    y = np.array([r.cls for r in held], float)
    if len(set(y)) < 2:  # too few to calibrate: the difference alone
        model.mean, model.scale, model.weights = np.zeros(3), np.ones(3), np.array([40.0, 0, 0, 0])
        return model
    x = np.array([r.x for r in held])
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    weight = np.where(y == 1, share[1] / n[1], share[0] / n[0]) * len(y)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = fit_logistic((x - model.mean) / model.scale, y, weight, l2=0.1)
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> CompressionModel | None:
    """Fit on labelled rows outside the held-out fold (crc32 of the id mod 5 = 0)."""
    known = labels.where(fold("doc_id", 5) > 0).where("quality in (0, 1)")
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    sample = checkpointed(labelled_sample(docs, known, F.col("quality"), per_class))
    total = sum(counts.values())
    return fit(sample, {c: n / total for c, n in counts.items()})


def score_quality(docs: DataFrame, model: CompressionModel | None, keep: list[str]) -> DataFrame:
    """``keep`` plus score; a map-only pass over whole texts."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: pa.Array) -> list:
        m = shared.value
        return [pa.array([m.score(t.as_py()) for t in texts], pa.float64())]

    return map_text(docs, "score double", fn, keep)


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
