"""Cleaning and packing of a corpus: each stage is one operator of ``tempora.llm`` over all that the stage before kept."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import exact_dedup, langid, ngram_join, packing
from tempora.llm import quality as bags
from tempora.llm.common import app_folder, delete, scratch, table, written
from tempora.llm.queries import vocabulary

#: Rows that Spark hands to Python at once. They hold whole texts, and both sides hold a batch and what comes of it.
BATCH_ROWS = 1_000


def _stage(function):
    """A stage, and all that follows it in its session, in batches of ``BATCH_ROWS``."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects. Learns from the labelled rows of its input."""
    return bags.keep_good(docs, bags.learn(docs, table(spark, sf_dir, "labels")))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that fit no learned language. Learns from the rows of its input."""
    return langid.keep_identified(docs, langid.learn(langid.training_rows(docs)))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop copies: of texts that are equal without white space, the longest with the smallest id stays."""
    return exact_dedup.keep_one(docs)


@_stage
def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each class of documents linked by 5-word shingles with a similarity of 0.8 or more."""
    return ngram_join.keep_one_each(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", similar),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage's rows are written, and the tables that it needed are deleted then, and
    so are the rows of the stage before; what is left goes with ``common.cleanup``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{app_folder(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None
