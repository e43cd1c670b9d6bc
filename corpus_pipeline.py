"""A corpus pipeline: quality filter, exact and near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.exact_dedup import drop_exact_copies
from tidewater.llm.jaccard_join import drop_near_copies
from tidewater.llm.packing import pack
from tidewater.llm.quality import THRESHOLD, fit, held_out, measured, score
from tidewater.llm.substring_dedup import drop_repeated_passages
from tidewater.storage import new_path, remove, save, scratch

VOCABULARY = "byte_bpe_50k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant rejects go; learnt from the labelled rows that are not held out."""
    model = fit(measured(docs.where(~held_out())), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, out="__score").where(f"__score >= {THRESHOLD}").drop("__score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, that with the smallest id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, that with the smallest id stays."""
    return drop_near_copies(docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds too are cut out of the texts."""
    return drop_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", packing),
]

#: The discriminant, the cut of passages and the vocabulary have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again for the next. The tables that a stage
    made on its way, and the result before, go when its result is written; the last stage's stay for the rows returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{k}")
        with scratch(spark):
            save(stage(spark, docs, sf_dir), path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
