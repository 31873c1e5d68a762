"""The whole way from raw words to subtitles, stage by stage; each stage is a function of tables, and its
result is written before the next one starts, so no stage is computed twice and no plan grows beyond one stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, contract, display, glossary, guards, metrics, rewrite, segmenter
from ..profiles import CardLimits, CorrectionLimits, LanguageProfile
from ..storage import kept


@dataclass
class Result:
    words: DataFrame
    edits: DataFrame
    warnings: DataFrame
    cards: DataFrame
    shown: DataFrame
    violations: DataFrame

    def report(self, limits: CardLimits = CardLimits()) -> DataFrame:
        return metrics.report(self.cards, limits)

    def subtitles(self, **how) -> DataFrame:
        return display.document(display.srt_blocks(self.shown, **how))


def ingest(raw: DataFrame, p: LanguageProfile) -> tuple[DataFrame, DataFrame]:
    """Repaired, clamped and numbered words, and a warning for each clamped one."""
    ws = rewrite.clamp(rewrite.join_marked(rewrite.join_numbers(raw), p))
    said = ws.filter("clamped").select("job_id", F.lit("timing_clamped").alias("code"), F.lit("moved to follow the word before").alias("detail"), F.col("wid").alias("wid_start"), F.col("wid").alias("wid_end"))
    return ws.select("job_id", "seg", "pos", "wid", "w", "start_ms", "end_ms", "conf"), said


def correct(ws: DataFrame, mappings: DataFrame, terms: DataFrame, p: LanguageProfile, limits: CorrectionLimits = CorrectionLimits(), proposals: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, edits and warnings after the passes that the limits name; without proposals the model's pass has nothing to do."""
    edits = warnings = None
    if "glossary" in limits.passes:
        ws, edits = glossary.apply(ws, mappings, terms, p, limits)
    if "llm" in limits.passes and proposals is not None:
        judged = guards.guarded(ws, proposals, mappings, terms, p, limits)
        ws = guards.apply(ws, judged)
        mine = judged.filter("kind in ('llm', 'punctuation')").select("job_id", "wid", "before", "after", F.col("kind").alias("reason"))
        edits = mine if edits is None else edits.unionByName(mine)
        warnings = judged.filter("kind in ('llm_rejected', 'edit_budget_hit')").select("job_id", F.col("kind").alias("code"), "detail", F.col("wid").alias("wid_start"), F.col("wid").alias("wid_end"))
    none = ws.sparkSession.createDataFrame([], f"job_id {ws.schema['job_id'].dataType.simpleString()}, wid long, before string, after string, reason string, code string, detail string, wid_start long, wid_end long")
    return ws, none.select("job_id", "wid", "before", "after", "reason") if edits is None else edits, none.select("job_id", "code", "detail", "wid_start", "wid_end") if warnings is None else warnings


def run(
    raw: DataFrame, mappings: DataFrame, terms: DataFrame, p: LanguageProfile, cards_like: CardLimits = CardLimits(), correct_like: CorrectionLimits = CorrectionLimits(),
    second: DataFrame | None = None, lexicon: DataFrame | None = None, proposals: DataFrame | None = None, onset: DataFrame | None = None, gap_ms: int = 0, close_ms: int = 0,
) -> Result:
    """raw (job_id, seg, pos, w, start_ms, end_ms, conf); second: another recogniser's repaired words, with a lexicon to judge by."""
    ws, warned = (kept(t) for t in ingest(raw, p))
    edits = None
    if second is not None and lexicon is not None:
        ws, edits = (kept(t) for t in align.resolve(ws, second, kept(lexicon), p))
    ws, more, rejected = (kept(t) for t in correct(ws, mappings, terms, p, correct_like, proposals))
    edits = more if edits is None else edits.unionByName(more)
    cards = kept(segmenter.cards(ws, p, cards_like))
    shown = display.ends(display.starts(cards, onset), gap_ms, close_ms)
    warnings = warned.unionByName(rejected).unionByName(segmenter.card_warnings(cards, ws, p, cards_like).select("job_id", "code", "detail", "wid_start", "wid_end"))
    if gap_ms > 0:
        warnings = warnings.unionByName(display.gap_warnings(shown, gap_ms).select("job_id", "code", "detail", "wid_start", "wid_end"))
    bad = contract.union([contract.word_checks(ws), contract.wid_order(ws), contract.card_checks(cards), contract.log_checks(warnings, edits)])
    return Result(ws, edits, warnings, cards, shown, bad)
