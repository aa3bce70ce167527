"""A training-corpus pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordlake.llm.catalog import TOXIC_SCORE, held_out, table, tokenizer_path
from recordlake.llm.decontaminate import clean_documents
from recordlake.llm.jaccard_groups import drop_near_duplicates
from recordlake.llm.mixing import mixed_rows
from recordlake.llm.scratch import fresh_path
from recordlake.llm.toxicity import drop_toxic, fit
from recordlake.llm.wavelet import document_digests, write_token_shards

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels that are not held out."""
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return drop_toxic(docs, model, TOXIC_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each component (five-word shingles, Jaccard similarity 0.8)."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 rows each."""
    return mixed_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards; returns each document's place in them, read back."""
    return document_digests(write_token_shards(docs, fresh_path(spark, "tokens"), tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: A learned classifier and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
