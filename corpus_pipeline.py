"""A corpus from raw documents to shards: five stages, each written as Parquet and read again before the next.

Every stage takes documents with doc_id, text, lang and source and any further columns, whatever their names, and all but the
last return the columns they were given. Null and empty texts, null sources and languages, rows without or with equal doc_id,
very long texts and empty tables are defined cases of each stage; they are stated with the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontaminate import remove_contaminated
from millrace.llm.language import keep_identified
from millrace.llm.mixing import mix
from millrace.llm.neardup import keep_one_each
from millrace.llm.sharding import shard_documents
from millrace.plans.checkpoints import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; models learn from the labels of the documents at hand and are calibrated on
    folds of them. Texts that are null or have no letter go; a null doc_id is judged like any other; without a label in the
    table nothing is identified and no row stays."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more. Texts without a word and rows
    without a doc_id stay; of rows with equal doc_id all stay or go together."""
    return keep_one_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items. Texts without words stay; rows are judged one by one."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times. A null source is a source of its own; texts without a word
    have no size and go with the hash of their doc_id; rows with equal doc_id are taken alike."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and place in it. Equal texts are kept together as far as shards stay even."""
    return shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Kneser-Ney models, sketches and label propagation have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
