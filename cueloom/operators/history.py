"""Fingerprints, reuse of stages, and the append-only benchmark table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(items: DataFrame) -> DataFrame:
    """items (job_id, track, timeline_start_ms, duration_ms, path, source_in_ms) -> job_id, fingerprint. Order, names and origin don't matter.

    Each item is hashed by itself, so a job's row holds hashes and no texts."""
    each = F.sha2(F.to_json(F.struct("track", "timeline_start_ms", "duration_ms", "path", "source_in_ms")), 256)
    return items.groupBy("job_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), ","), 256).alias("fingerprint"))


def stale(now: DataFrame, kept: DataFrame) -> DataFrame:
    """Jobs whose input has no result with the same fingerprint."""
    return now.join(kept, ["job_id", "fingerprint"], "left_anti")


def prepared(now: DataFrame, stored: DataFrame, audio: DataFrame) -> DataFrame:
    """now (job_id, fingerprint), stored (the same, of the last run), audio (job_id) -> job_id, state: reused where the input is unchanged and its audio is there, otherwise rendered. A null fingerprint is never reused."""
    same = now.join(stored.select("job_id", "fingerprint").distinct(), ["job_id", "fingerprint"], "left_semi").join(audio.select("job_id").distinct(), "job_id", "left_semi")
    return now.select("job_id").join(same.select("job_id", F.lit("reused").alias("state")), "job_id", "left").withColumn("state", F.coalesce("state", F.lit("rendered")))


def bench_rows(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """A row a job: a failed job has no scores, and null ones rather than zeros. jobs (job_id, failure_reason), scores (job_id, ...)."""
    ok = jobs.filter("failure_reason is null").select("job_id")
    measured = scores.join(ok.hint("merge"), "job_id", "left_semi")
    return jobs.select("job_id", F.when(F.col("failure_reason").isNull(), "ok").otherwise("failed").alias("status"), "failure_reason").join(measured.hint("merge"), "job_id", "left")


def means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Over jobs that ran; what was not measured doesn't count."""
    return rows.filter("status = 'ok'").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def append_words(spark: SparkSession, new: DataFrame, path: str) -> None:
    """New words that the list does not hold yet, sorted within each part."""
    held = spark.read.text(path).select(F.col("value").alias("word"))
    new.join(held, "word", "left_anti").distinct().sortWithinPartitions("word").select(F.col("word").alias("value")).write.mode("append").text(path)
