from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: nulls, empty and blank texts, a very long one, repeated rows, equal texts, odd characters
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", None, 3),
    (5, "idiot " * 3, "en", "b", 18), (5, "idiot " * 3, "en", "b", 18), (6, "same words in both of these texts", "en", "c", 33),
    (7, "same words in both of these texts", "en", "c", 33), (8, "é漢𝄞\u0000z ▁▁ x", "fr", "c", 11),
    (9, "long text with many words " * 20_000, "en", "hot", 520_000), (None, "a row without an id", "en", "hot", 19),
    (10, "\x1f\xa0\u2028 unusual spaces", "de", "", 18),
]


@pytest.fixture()
def edge(spark):
    """Edge-case documents with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(EDGE, DOC)
    extra = ["score", "cls", "size", "n", "sid", "kind", "_h", "_id", "h", "w", "key", "copies", "digits", "label", "a", "b"]
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in extra])


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture()
def save(tmp_path):
    """Write tables as the queries read them; returns the folder."""
    def write(**tables) -> str:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
