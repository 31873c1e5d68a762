"""Token repair and clamping: sequence rewrites expressed as islands and running extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import LanguageProfile

IN_SEGMENT = ("job_id", "seg")


def _join_islands(ws: DataFrame, continues: Column) -> DataFrame:
    """Rows that continue the one before merge into it: texts run together, the last end, the least confidence that is known.

    Whether a row continues depends on the previous row's own last letter only, for a merged token ends as its last piece does;
    so one lag is enough, however long the chain.
    """
    w = W.partitionBy(*IN_SEGMENT).orderBy("pos")
    marked = ws.withColumn("_c", continues.cast("int")).withColumn("_g", F.sum(1 - F.col("_c")).over(w))
    merged = marked.groupBy(*IN_SEGMENT, "_g").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), "").alias("w"),
        F.min_by("start_ms", "pos").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
        F.min("conf").alias("conf"),
    )
    return merged.drop("_g")


def join_numbers(ws: DataFrame) -> DataFrame:
    """"75" ",000" is one token where the one before ends in a digit."""
    before = F.lag("w").over(W.partitionBy(*IN_SEGMENT).orderBy("pos"))
    return _join_islands(ws, F.coalesce(F.col("w").rlike(r"^[,.]\p{Nd}") & before.rlike(r"\p{Nd}$"), F.lit(False)))


def join_marked(ws: DataFrame, p: LanguageProfile) -> DataFrame:
    """A token that begins with a mark and a letter belongs to a token ending in a letter that takes the mark."""
    before = F.lag("w").over(W.partitionBy(*IN_SEGMENT).orderBy("pos"))
    return _join_islands(ws, F.coalesce(F.col("w").rlike(f"^[{p.marks}][{p.letters}]") & before.rlike(f"[{p.marked_letters}]$"), F.lit(False)))


def clamp(ws: DataFrame) -> DataFrame:
    """Starts no earlier than the previous end, ends at least 1 ms later; adds clamped.

    The rule start' = max(start, end'[i-1]), end' = end if end > start' else start' + 1 is in whole milliseconds
    end' = max(end, start + 1, end'[i-1] + 1), so end' - i is a running maximum: one window, no fold.
    """
    w = W.partitionBy("job_id").orderBy("seg", "pos")
    numbered = ws.filter(F.trim("w") != "").withColumn("_i", F.row_number().over(w).cast("long"))
    top = F.greatest(F.max(F.greatest("end_ms", F.col("start_ms") + 1) - F.col("_i")).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0).cast("long")) + F.col("_i")
    ended = numbered.withColumn("_end", top)
    start = F.greatest("start_ms", F.coalesce(F.lag("_end").over(w), F.lit(0).cast("long")))
    out = ended.withColumn("_start", start).withColumn("clamped", (F.col("_start") != F.col("start_ms")) | (F.col("_end") != F.col("end_ms")))
    return out.withColumns({"start_ms": F.col("_start"), "end_ms": F.col("_end"), "wid": F.col("_i") - 1}).drop("_i", "_start", "_end")


def segments(ws: DataFrame) -> DataFrame:
    """(job_id, seg, start_ms, end_ms, text, n_words) of words in order."""
    return ws.groupBy("job_id", "seg").agg(
        F.min_by("start_ms", "wid").alias("start_ms"),
        F.max_by("end_ms", "wid").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wid", "w"))), lambda x: x["w"]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_words"),
    )


def sentences(ws: DataFrame) -> DataFrame:
    """Adds sent: a sentence closes after the word that ends it; and k, the word's place in it."""
    w = W.partitionBy("job_id").orderBy("wid")
    ends = T.ends_sentence(F.col("w")).cast("int")
    out = ws.withColumn("sent", F.coalesce(F.sum(ends).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return out.withColumn("k", F.row_number().over(W.partitionBy("job_id", "sent").orderBy("wid")).cast("long") - 1)
