"""A training-data pipeline from the operators of quarry.llm.

STAGES are run in order over the table of documents: documents that the quality rules reject go; one document of each
group of near duplicates stays (the row with the least id, rows without an id last; of rows that repeat that id in the group
the one with the least hashes of its shingles and then of its columns, so two texts of one id are told apart); documents with a benchmark item go; secrets are
masked; what is left is packed into sequences. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import scratch
from quarry.llm.decontaminate import drop_leaks
from quarry.llm.ngram_join import keep_first
from quarry.llm.packing import pack
from quarry.llm.quality_rules import keep_good
from quarry.llm.secret_scan import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]

#: Words of edits, certified cutoffs and token ids have no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table of documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = scratch.Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = held.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            held.drop(f"stage-{k - 1}")
    return docs
