"""A live stream of words, cut into utterances: beyond what batch operators need, and built from them.

Words of a job that follow each other within ``pause`` belong to one utterance; a watermark closes utterances, and late words within
it still join theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utterances(words: DataFrame, pause: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """words (job_id, ts, w) as a stream or a table -> job_id, started, ended, n_words, text."""
    kept = words.withWatermark("ts", late) if words.isStreaming else words
    by = kept.groupBy("job_id", F.session_window("ts", pause).alias("span"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "w"))), lambda x: x["w"]), " ")
    return by.agg(F.count(F.lit(1)).alias("n_words"), said.alias("text")).select("job_id", F.col("span.start").alias("started"), F.col("span.end").alias("ended"), "n_words", "text")


def warning_counts(warnings: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """warnings (ts, code) -> window, code, n: a running count for a monitor."""
    kept = warnings.withWatermark("ts", late) if warnings.isStreaming else warnings
    return kept.groupBy(F.window("ts", every).alias("window"), "code").agg(F.count(F.lit(1)).alias("n"))
