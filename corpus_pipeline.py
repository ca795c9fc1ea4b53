"""The corpus pipeline: documents through toxicity filter, line dedup, near-dedup, mixing and tokenising.

``run`` writes each stage's rows as Parquet into the shared folder of ``spark.checkpoint.dir`` and reads them again as
the next one's documents, so a lost executor costs the tasks of one stage and no lineage grows over the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagwright.llm import linededup, mixing, simhash, spm, toxicity
from tagwright.session import drop_path, scratch_path
from tagwright.sources.tables import load

NEAR_COPY_SHARE = 0.8  # a document that loses this share of its words and is as like an earlier document is a copy of it


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on labelled rows of ``docs`` (a bounded sample, see toxicity.Config) and rejects what scores 0.5 or more."""
    return toxicity.reject_toxic(docs, load(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; what has no words left, or is a copy of one earlier document by 0.8, goes as a whole."""
    return linededup.dedup_documents(docs, NEAR_COPY_SHARE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 2 bits or fewer stays."""
    return simhash.one_per_group(docs, shingle=3, distance=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: documents are repeated or left out as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of the text."""
    d = spm.encode(docs, spm.read_model())
    return d.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece encoding", encode_stage),
]

#: SQL can't express the toxicity model, XXH64 and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)   # read for the last time by the stage just written
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
