"""Counts and scores. What was not measured is null; zero means measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import WARNING_CODES, CardLimits, LanguageProfile


def warning_counts(warnings: DataFrame) -> DataFrame:
    """A column for each code, zero where it did not occur."""
    return warnings.groupBy("job_id").agg(*[F.count_if(F.col("code") == c).alias(f"warn_{c}") for c in WARNING_CODES])


def rule_breakdown(warnings: DataFrame) -> DataFrame:
    """job_id, breakdown: "rule=n;..." by rule name."""
    n = warnings.filter("code = 'hebrew_rule_violation'").groupBy("job_id", F.split_part("detail", F.lit(": "), F.lit(1)).alias("rule")).count()
    return n.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "rule", F.col("count").cast("string")))), ";").alias("breakdown"))


def report(cards: DataFrame, limits: CardLimits = CardLimits()) -> DataFrame:
    """cards (job_id, start_ms, end_ms, lines, cps)."""
    return cards.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("cards"),
        F.count_if(F.col("cps") > limits.max_cps).alias("cards_over_cps"),
        F.count_if(F.exists("lines", lambda x: F.length(x) > limits.line_chars)).alias("cards_over_line_len"),
        F.count_if(F.col("end_ms") - F.col("start_ms") < limits.min_ms).alias("cards_under_min_duration"),
        F.max("cps").alias("max_cps"),
        F.round(F.avg("cps"), 3).alias("mean_cps"),
    )


def closed_gaps(cards: DataFrame, close_ms: int) -> DataFrame:
    """Gaps that closing would close, by spoken starts."""
    gap = F.lead("start_ms").over(W.partitionBy("job_id").orderBy("card")) - F.col("end_ms")
    return cards.withColumn("_g", gap).groupBy("job_id").agg(F.count_if((F.col("_g") > 0) & (F.col("_g") <= close_ms)).alias("closed_gaps"))


def sidecars(shown: DataFrame, warnings: DataFrame, source: Column, close_ms: int = 0, timing: bool = False, limits: CardLimits = CardLimits()) -> DataFrame:
    """job_id, report: what is written beside a subtitle file, as JSON: its source (of job_id), the warnings of writing it, and counts of its cards. shown: cards with shown_start; timing: whether a timing card was asked for, the report tells whether there was room."""
    first = shown.groupBy("job_id").agg((F.min_by("shown_start", "card") > 0).alias("room"))
    gaps = closed_gaps(shown, close_ms) if close_ms > 0 else shown.select("job_id").distinct().withColumn("closed_gaps", F.lit(0).cast("long"))
    listed = warnings.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("card", "code", "detail", "wid_start", "wid_end"))).alias("w"))
    stats = report(shown, limits).withColumns({c: F.coalesce(F.round(c, 3), F.lit(0.0)) for c in ("max_cps", "mean_cps")}).join(gaps, "job_id").join(first, "job_id").join(listed, "job_id", "left")
    told = F.transform(F.coalesce("w", F.array().cast(listed.schema["w"].dataType)), lambda x: F.struct(x["code"].alias("code"), x["detail"].alias("detail"), x["wid_start"].alias("wid_start"), x["wid_end"].alias("wid_end")))
    counts = F.struct("cards", "cards_over_cps", "cards_over_line_len", "cards_under_min_duration", "max_cps", "mean_cps", "closed_gaps", (F.lit(timing) & F.col("room")).alias("timing_clip"))
    return stats.select("job_id", F.to_json(F.struct(source.alias("source"), told.alias("warnings"), counts.alias("stats"))).alias("report"))


def share_over_cps() -> Column:
    return F.when(F.col("cards") > 0, F.round(F.col("cards_over_cps") / F.col("cards"), 4))


def edit_counts(edits: DataFrame) -> DataFrame:
    return edits.groupBy("job_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def code_examples(warnings: DataFrame, most: int = 3) -> DataFrame:
    """Each code with its count and its first detail; the first `most` codes in order of appearance."""
    by = warnings.groupBy("job_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min_by("detail", "ord").alias("example"), F.min("ord").alias("first"))
    return by.withColumn("r", F.row_number().over(W.partitionBy("job_id").orderBy("first", "code"))).filter(F.col("r") <= most).drop("r", "first")


def review_report(flags: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` flags of a job by wid, and how many more there are."""
    w = W.partitionBy("job_id")
    ranked = flags.withColumns({"r": F.row_number().over(w.orderBy("wid")), "n": F.count(F.lit(1)).over(w)})
    return ranked.filter(F.col("r") <= most).withColumn("more", F.greatest(F.col("n") - most, F.lit(0))).drop("r", "n")


def entity_accuracy(texts: DataFrame, terms: DataFrame, p: LanguageProfile) -> DataFrame:
    """texts (job_id, ref, hyp), terms (term) -> job_id, accuracy: of the terms' occurrences in the reference, those that the other text has too; null where there are none. Terms that read alike count once each.

    Words and terms meet word by word, by equality with a word or its form without an attached letter; where all words of a term stand in a row, it occurs.
    The terms are sent whole, as a list that people keep; the words never are.
    """
    ts = terms.select(T.words_for_scoring(F.col("term"), p).alias("t")).filter(F.size("t") > 0).groupBy("t").agg(F.count(F.lit(1)).alias("times"))
    parts = F.broadcast(ts.select("t", "times", F.posexplode("t").alias("k", "word")))

    def found(col: str) -> DataFrame:
        ws = texts.select("job_id", F.posexplode(T.words_for_scoring(F.col(col), p)).alias("i", "w"))
        at = ws.select("job_id", "i", F.explode(F.array_distinct(T.variants(F.col("w"), p))).alias("word"))
        whole = at.join(parts, "word").groupBy("job_id", "t", "times", (F.col("i") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") == F.size("t"))
        return whole.groupBy("job_id", "t").agg((F.count(F.lit(1)) * F.max("times")).alias("n"))

    both = found("ref").alias("a").join(found("hyp").withColumnRenamed("n", "m").hint("merge"), ["job_id", "t"], "left")
    n = both.groupBy("job_id").agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("accuracy"))
    return texts.select("job_id").join(n.hint("merge"), "job_id", "left")
