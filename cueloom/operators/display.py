"""What is shown when: displayed starts and ends of cards, the timing card, and rendered subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans

#: Fixed value: the text of the card before the first one.
TIMING_TEXT = ">> TIMING CLIP - DELETE ME <<"


def _order():
    return W.partitionBy("job_id").orderBy("card")


def starts(cards: DataFrame, onset: DataFrame | None = None) -> DataFrame:
    """Adds shown_start: a card that starts outside every onset span moves to the next span's start if it begins before the card ends. No spans, no moves."""
    if onset is None:
        return cards.withColumn("shown_start", F.col("start_ms"))
    seen = spans.next_start(cards.withColumn("t", F.col("start_ms")), onset.select("job_id", "s", "e"), ["job_id"])
    moved = F.when(~F.col("inside") & F.col("next").isNotNull() & (F.col("next") < F.col("end_ms")), F.col("next")).otherwise(F.col("start_ms"))
    return seen.withColumn("shown_start", moved).drop("t", "inside", "next")


def ends(cards: DataFrame, gap_ms: int = 0, close_ms: int = 0) -> DataFrame:
    """Adds shown_end and applied_ms (the gap opened). Either gaps are closed or opened."""
    if gap_ms > 0 and close_ms > 0:
        raise ValueError("a gap can be opened or closed, not both")
    following = F.lead("shown_start").over(_order())
    gap = following - F.col("end_ms")
    if close_ms > 0:
        shown = F.when((gap > 0) & (gap <= close_ms), following).otherwise(F.col("end_ms"))
        return cards.withColumns({"shown_end": shown, "applied_ms": F.lit(None).cast("long")})
    if gap_ms <= 0:
        return cards.withColumns({"shown_end": F.col("end_ms"), "applied_ms": F.lit(None).cast("long")})
    slack = F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms") - 1)
    applied = F.when(following.isNotNull() & (gap <= 0), F.least(F.lit(gap_ms).cast("long"), slack))
    return cards.withColumns({"applied_ms": applied, "shown_end": F.col("end_ms") - F.coalesce(applied, F.lit(0))})


def gap_warnings(shown: DataFrame, gap_ms: int) -> DataFrame:
    detail = F.concat(F.lit(f"requested {gap_ms}ms, applied "), F.col("applied_ms").cast("string"), F.lit("ms"))
    return shown.filter(F.col("applied_ms") < gap_ms).select("job_id", "card", F.lit("gap_not_applied").alias("code"), detail.alias("detail"), F.col("first_wid").alias("wid_start"), F.col("last_wid").alias("wid_end"))


def timing_card(shown: DataFrame) -> DataFrame:
    """One card a job from zero to the first shown start, where there is room."""
    first = shown.groupBy("job_id").agg(F.min_by("shown_start", "card").alias("first")).filter("first > 0")
    return first.select("job_id", F.lit(-1).cast("long").alias("card"), F.lit(0).cast("long").alias("shown_start"), F.col("first").alias("shown_end"), F.array(F.lit(TIMING_TEXT)).alias("lines"))


def srt_blocks(shown: DataFrame, with_timing: bool = False, **decoration: bool) -> DataFrame:
    """job_id, card, block: numbered from 1, the timing card first."""
    rows = shown.select("job_id", "card", "shown_start", "shown_end", F.transform("lines", lambda x: T.decorate(x, **decoration)).alias("lines"))
    if with_timing:
        rows = rows.unionByName(timing_card(shown))
    number = F.row_number().over(_order())
    block = F.concat(number.cast("string"), F.lit("\n"), T.clock(F.col("shown_start")), F.lit(" --> "), T.clock(F.col("shown_end")), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n\n"))
    return rows.select("job_id", "card", block.alias("block"))


def vtt_blocks(shown: DataFrame, **decoration: bool) -> DataFrame:
    """Starts as spoken, ends as shown."""
    lines = F.array_join(F.transform("lines", lambda x: T.decorate(x, **decoration)), "\n")
    block = F.concat(T.clock(F.col("start_ms"), "."), F.lit(" --> "), T.clock(F.col("shown_end"), "."), F.lit("\n"), lines, F.lit("\n\n"))
    return shown.select("job_id", "card", block.alias("block"))


def document(blocks: DataFrame, head: str = "") -> DataFrame:
    """job_id, text: the blocks of a job in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("card", "block"))), lambda x: x["block"])
    return blocks.groupBy("job_id").agg(F.concat(F.lit(head), F.array_join(ordered, "")).alias("text"))


VTT_HEAD = "WEBVTT\n\n"


def review_cards(cards: DataFrame, flags: DataFrame) -> DataFrame:
    """Cards to look at: what was heard over the other hearing, at the card that holds the word."""
    words = cards.select("job_id", "card", "start_ms", "end_ms", F.explode(F.sequence("first_wid", "last_wid")).alias("wid"))
    return flags.select("job_id", "wid", "heard", "alternative").join(words, ["job_id", "wid"]).select("job_id", "card", "wid", "start_ms", "end_ms", F.concat_ws("\n", "heard", "alternative").alias("text"))


def markers(flags: DataFrame, fps: Column, most: int = 3) -> DataFrame:
    """job_id, wid, frame: frame of the word's start; words that fall on one frame move up to `most` frames on, others are left out."""
    at = F.round(F.col("start_ms") * fps / 1000).cast("long")
    w = W.partitionBy("job_id", "frame").orderBy("wid")
    return flags.withColumn("frame", at).withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") <= most).withColumn("frame", F.col("frame") + F.col("_n")).drop("_n")
