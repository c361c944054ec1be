"""A training corpus from raw documents, in five stages. Each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskloom.llm import bpe, exact_dedup, langid, mixing, queries, simhash
from duskloom.llm.common import dropped, with_checkpoints

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those with 'und' go: null and empty texts and those without a letter. lang becomes the
    identified one. Repeated rows are judged alike; an empty table gives none."""
    profiles = langid.learn_profiles(langid.training_rows(docs))
    found = langid.predict_languages(docs.select(COLUMNS), profiles)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id (a null is the smallest); empty texts are a group, rows that
    repeat a doc_id and a text count once, an empty table gives no rows."""
    return exact_dedup.keep_distinct(docs.select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest doc_id, over shingles of five words and four sketches; the measured
    recall by similarity is in the README. A null doc_id stays; an empty table gives no rows."""
    return simhash.keep_one_of_each(docs.select(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts so that sources have their target shares, in a global hash order. A null source is
    a source of its own; an empty table gives no rows."""
    return mixing.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The BPE ids of each row as digests, with the check that they decode to its text. A null text is empty."""
    return bpe.bpe_digests(docs, queries.bpe_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: Neither profile ranks nor fingerprints can be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What lies between two stages is a table in the shared checkpoint folder, deleted when the
    stage after it has been written; the last one is what the result reads."""
    with_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES[:-1], 1):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
        if last:
            dropped(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
