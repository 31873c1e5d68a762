"""The words table, and the views of the driver's tables that stand in for recogniser output.

``words`` is the fact table: job_id, seg, pos, wid, w, start_ms, end_ms, conf; wid counts the words of a job from 0 in document order.
Times are whole milliseconds, so that no rounding rule enters anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def flatten(conversations: DataFrame) -> DataFrame:
    """One row a token, in document order."""
    each = conversations.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seg"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "w"))
    return each.withColumn("wid", F.row_number().over(W.partitionBy("job_id").orderBy("seg", "pos")).cast("long") - 1)


def timed(flat: DataFrame) -> DataFrame:
    """Invented but regular timings: 200 to 319 ms a word, pauses of 0 to 120 ms."""
    dur = F.lit(200) + (F.col("wid") * 37) % 120
    gap = F.element_at(F.array(*map(F.lit, (0, 10, 30, 60, 120))), ((F.col("wid") * 7 + F.col("job_id")) % 5 + 1).cast("int"))
    before = F.coalesce(F.sum(dur + gap).over(W.partitionBy("job_id").orderBy("wid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return flat.withColumn("start_ms", before).withColumn("end_ms", F.col("start_ms") + dur).withColumn("conf", ((F.col("wid") * 37 + F.col("job_id") * 11) % 100) / 100.0)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(flatten(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).select("job_id", "seg", "pos", "wid", "w", "start_ms", "end_ms", "conf")


def fragmented(ws: DataFrame) -> DataFrame:
    """Numbers and marked letters split over tokens, as recognisers do."""
    w, i = F.col("w"), F.col("wid")
    w = F.when(i % 13 == 5, (i % 100).cast("string")).when((i % 13 == 6) | (i % 26 == 7), F.concat(F.lit(","), F.lpad((i % 1000).cast("string"), 3, "0"))).otherwise(w)
    w = F.when((i % 17 == 3) & (i % 13 > 7), F.concat(w, F.lit("g"))).when((i % 17 == 4) & (i % 13 > 7), F.concat(F.lit("'"), w)).otherwise(w)
    return ws.withColumn("w", w)


def broken(ws: DataFrame) -> DataFrame:
    """Some starts too early, some words without length."""
    start = F.when(F.col("wid") % 13 == 0, F.col("start_ms") - 400).otherwise(F.col("start_ms"))
    end = F.when(F.col("wid") % 29 == 7, F.col("start_ms")).otherwise(F.col("end_ms"))
    return ws.withColumns({"start_ms": start, "end_ms": end})


def second_opinion(ws: DataFrame) -> DataFrame:
    """Another recogniser: every 17th word with letters swapped, every 102nd left out."""
    w = F.when(F.col("wid") % 17 == 0, F.translate("w", "aeiou", "eioua")).otherwise(F.col("w"))
    return ws.withColumn("w", w).filter("wid % 102 <> 60")
