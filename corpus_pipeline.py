"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Language ID drops documents that it rejects; exact dedup keeps one of equal
texts; near dedup keeps one of each class of near copies; mixing repeats or
drops documents so that sources meet their target weights; BPE encodes what is
left. All but the last return the columns of ``documents``.

Defined cases, by stage: a null text, or one without a letter, has no language and goes with the first stage; of
equal texts the largest id stays, a row without id only where none has one; near dedup keeps rows without id and
one text of each class, the smallest id; mixing takes a document of any size up to three times, one without
words once; repeated rows are one document to the dedup stages and documents of their own to the others. Very
long texts go through whole. An empty table gives an empty result, and columns of any name stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from floeline.llm import bpe, exact_dedup, langid, mixing, near_dedup
from floeline.llm.shared import documents, reachable, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return langid.accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mix), ("bpe", encode)]

#: Stages 1, 3 and 4 (a fitted model, sketches, Newton iterations) have no SQL; tests/llm holds the plain Python version of
#: all stages but the language model's verdicts, which it takes from op5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
