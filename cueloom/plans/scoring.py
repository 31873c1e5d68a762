"""The benchmark table: a row a job, with every metric that could be measured and nulls for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, history, metrics, spans
from ..profiles import LanguageProfile


def scores(texts: DataFrame, cards: DataFrame, reference_starts: DataFrame, warnings: DataFrame, terms: DataFrame, p: LanguageProfile) -> DataFrame:
    """texts (job_id, ref, hyp), reference_starts (job_id, t) -> a row for each job of texts."""
    ref, hyp = T.words_for_scoring(F.col("ref"), p), T.words_for_scoring(F.col("hyp"), p)
    bare = lambda c: F.transform(c, lambda x: T.skeleton(x, p))
    words = texts.select("job_id", align.wer(ref, hyp).alias("wer"), align.wer(bare(ref), bare(hyp)).alias("wer_tolerant"), align.punct_f1(F.col("ref"), F.col("hyp"), p).alias("punct_f1"))
    entity = metrics.entity_accuracy(texts, terms, p).withColumnRenamed("accuracy", "entity_accuracy")
    cuts = spans.boundary_f1(reference_starts, cards.select("job_id", F.col("start_ms").alias("t")).distinct(), ["job_id"]).withColumnRenamed("f1", "boundary_f1")
    report = metrics.report(cards).withColumn("pct_over_cps", metrics.share_over_cps())
    counts = metrics.warning_counts(warnings)
    rules = metrics.rule_breakdown(warnings).withColumnRenamed("breakdown", "hebrew_rule_breakdown")
    out = words
    for part in (entity, cuts, report, counts, rules):
        out = out.join(part.hint("merge"), "job_id", "left")
    return out.na.fill(0, [c for c in out.columns if c.startswith("warn_")])


def table(jobs: DataFrame, scored: DataFrame) -> DataFrame:
    """jobs (job_id, failure_reason): a failed job has no scores."""
    return history.bench_rows(jobs, scored)
