"""A corpus pipeline: quality rules, line deduplication, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the last return the columns of ``documents``; n_chars
follows the text where lines were cut. The stages have no SQL oracle: fingerprints and the mix's pseudorandom draws are beyond SQL;
tests/llm holds them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import common, decontam, jaccard, lines, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.filter_documents(common.keep_columns(docs, COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines shared by many sources are cut, but for pages that consist of them by the next stage's similarity, which are copies; every document stays."""
    cut = lines.remove_boilerplate(common.keep_columns(docs, COLUMNS), spare=jaccard.OVER / jaccard.UNDER)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more, found by SimHash and completed exactly, stays: the one with the smallest doc_id."""
    return jaccard.drop_near_duplicates(common.keep_columns(docs, COLUMNS)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others are left as they are."""
    return decontam.drop_contaminated(common.keep_columns(docs, COLUMNS), common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.taken(common.keep_columns(docs, COLUMNS))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared checkpoint folder, and goes when the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = common.new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            common.drop_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
