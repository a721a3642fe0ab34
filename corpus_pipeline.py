"""A training-data pipeline over ``documents``: each stage filters or changes
what its predecessor kept, and is written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.common import table
from storelens.llm.mixing import mixing_stage
from storelens.llm.ngram_join import dedup_stage
from storelens.llm.secrets import secrets_stage
from storelens.llm.spm_codec import spm_stage
from storelens.llm.toxicity import toxicity_stage
from storelens.session import ensure_checkpoint_dir
from storelens.sources.sinks import file_system

#: (name, function(spark, docs, sf_dir)); all but the last return the columns of documents
STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", spm_stage),
]

#: No SQL can express the classifier and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is a Parquet folder beside the checkpoints.

    A stage's folder goes once the next one is written; the last one backs the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            fs, hadoop = file_system(spark, before)
            fs.delete(hadoop(before), True)
        before = path
    return docs
