"""The data contract as queries that return a row for each violation: (job_id, path, problem)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..profiles import EDIT_REASONS, WARNING_CODES

SLACK_CPS = 0.05


def _found(df: DataFrame, bad: Column, path: Column, problem: str) -> DataFrame:
    return df.filter(bad).select("job_id", path.alias("path"), F.lit(problem).alias("problem"))


def _word(name: str = "wid") -> Column:
    return F.concat(F.lit("word "), F.col(name).cast("string"))


def _seg() -> Column:
    return F.concat(F.lit("segment "), F.col("seg").cast("string"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def wid_order(ws: DataFrame) -> DataFrame:
    """wids strictly rise in document order."""
    w = W.partitionBy("job_id").orderBy("seg", "pos")
    return _found(ws.withColumn("_p", F.lag("wid").over(w)), F.col("_p") >= F.col("wid"), _word(), "wid does not rise")


def word_checks(ws: DataFrame) -> DataFrame:
    w = W.partitionBy("job_id", "seg").orderBy("wid")
    near = ws.withColumn("_p", F.lag("end_ms").over(w))
    return union(
        [
            _found(near, F.col("end_ms") <= F.col("start_ms"), _word(), "end is not after start"),
            _found(near, F.col("start_ms") < 0, _word(), "start is negative"),
            _found(near, F.col("_p") > F.col("start_ms"), _word(), "overlaps the word before"),
            _found(near, (F.col("conf") < 0) | (F.col("conf") > 1), _word(), "confidence is not from 0 to 1"),
            _found(near, F.col("w").isNull() | (F.col("w") == "") | F.col("w").rlike(r"(?U)\s"), _word(), "empty or holds white space"),
        ]
    )


def segment_checks(segs: DataFrame, ws: DataFrame) -> DataFrame:
    """segs (job_id, seg, start_ms, end_ms, text) against their words."""
    own = ws.groupBy("job_id", "seg").agg(
        F.min("start_ms").alias("_s"), F.max("end_ms").alias("_e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wid", "w"))), lambda x: x["w"]), " ").alias("_t")
    )
    joined = segs.join(own, ["job_id", "seg"], "left")
    order = W.partitionBy("job_id").orderBy("seg")
    near = segs.withColumn("_p", F.lag("end_ms").over(order))
    twice = segs.groupBy("job_id", "seg").count()
    return union(
        [
            _found(joined, F.col("_t").isNull(), _seg(), "no words"),
            _found(joined, F.col("_t") != F.col("text"), _seg(), "text is not its words"),
            _found(joined, (F.col("_s") < F.col("start_ms")) | (F.col("_e") > F.col("end_ms")), _seg(), "words outside its bounds"),
            _found(near, F.col("_p") > F.col("start_ms"), _seg(), "overlaps the segment before"),
            _found(twice, F.col("count") > 1, _seg(), "id is not unique"),
        ]
    )


def card_checks(cards: DataFrame) -> DataFrame:
    """cards (job_id, card, start_ms, end_ms, text, lines, cps)."""
    path = F.concat(F.lit("card "), F.col("card").cast("string"))
    cps = F.length("text") * 1000.0 / (F.col("end_ms") - F.col("start_ms"))
    return union(
        [
            _found(cards, (F.size("lines") < 1) | (F.size("lines") > 2), path, "not one or two lines"),
            _found(cards, F.exists("lines", lambda x: F.trim(x) == ""), path, "blank line"),
            _found(cards, F.array_join("lines", " ") != F.col("text"), path, "lines are not the text"),
            _found(cards, F.abs(F.col("cps") - cps) > SLACK_CPS + 1e-9, path, "cps is off"),
        ]
    )


def log_checks(warnings: DataFrame, edits: DataFrame) -> DataFrame:
    some = F.col("wid_start").isNull() != F.col("wid_end").isNull()
    at = F.concat(F.lit("warning "), F.col("code"))
    return union(
        [
            _found(warnings, ~F.col("code").isin(*WARNING_CODES), at, "unknown code"),
            _found(warnings, some, at, "only one end of the range"),
            _found(warnings, F.col("wid_start") > F.col("wid_end"), at, "range runs backwards"),
            _found(edits, ~F.col("reason").isin(*EDIT_REASONS), _word(), "unknown reason"),
        ]
    )


def cards_cover_words(cards: DataFrame, ws: DataFrame) -> DataFrame:
    """Words in no card or in two: cards (job_id, first_wid, last_wid). No rows where cards tile the words."""
    inside = cards.select("job_id", F.explode(F.sequence("first_wid", "last_wid")).alias("wid")).groupBy("job_id", "wid").agg(F.count(F.lit(1)).alias("n"))
    both = ws.select("job_id", "wid", F.lit(1).alias("_here")).join(inside, ["job_id", "wid"], "full_outer")
    return both.filter((F.col("_here").isNull()) | F.col("n").isNull() | (F.col("n") != 1)).select("job_id", "wid")


def shape_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words whose place or times a correction changed: none, if it kept to the contract."""
    keys = ["job_id", "seg", "pos", "wid", "start_ms", "end_ms"]
    return before.select(*keys).exceptAll(after.select(*keys)).unionByName(after.select(*keys).exceptAll(before.select(*keys)))


def first_violation(violations: DataFrame) -> DataFrame:
    return violations.groupBy("job_id").agg(F.min(F.struct("path", "problem")).alias("v")).select("job_id", "v.*")
