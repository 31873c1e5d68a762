"""What a break between two words costs, and where a card's lines part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import GAP_BONUS, RULE_WEIGHTS, CardLimits, LanguageProfile


def violated(left: Column, right: Column, p: LanguageProfile) -> Column:
    """Ids of the rules that a break between the words breaks; none after the end of a sentence or before nothing."""
    a, b = T.bare(left), T.bare(right)
    chain = F.lit(False)
    for form in (a, F.when((F.length(a) >= 3) & F.substring(a, 1, 1).isin(*p.prefixes), F.substring(a, 2, 1_000_000))):
        chain = chain | F.coalesce(F.concat_ws(" ", form, b).isin(*(f"{x} {y}" for x, y in p.chains)), F.lit(False))
    rules = [
        F.when(a == p.object_marker, F.lit("et_split")).when(a.isin(*p.function_words), F.lit("function_word_line_end")),
        F.when(chain, F.lit("construct_chain_split")),
        F.when(T.has_digit(a) & b.isin(*p.units), F.lit("number_unit_split")),
    ]
    if p.latin_rule:
        rules.append(F.when(T.has_latin(left) & T.has_latin(right), F.lit("english_phrase_split")))
    none = F.array().cast("array<string>")
    return F.when(right.isNull() | T.ends_sentence(left), none).otherwise(F.array_compact(F.array(*rules)))


def rule_cost(rules: Column) -> Column:
    weight = F.lit(0)
    for name, w in RULE_WEIGHTS.items():
        weight = weight + F.when(F.array_contains(rules, name), w).otherwise(0)
    return weight


def gap_bonus(gap_ms: Column) -> Column:
    out = None
    for least, bonus in GAP_BONUS:
        out = F.when(gap_ms >= least, bonus) if out is None else out.when(gap_ms >= least, bonus)
    return out.otherwise(0.0)


def break_costs(ws: DataFrame, p: LanguageProfile) -> DataFrame:
    """Adds rules, gap_ms and break_cost of the break after each word of a sentence; the sentence's last has none. ws has sent."""
    w = W.partitionBy("job_id", "sent").orderBy("wid")
    right = F.lead("w").over(w)
    near = ws.withColumns({"_right": right, "gap_ms": F.lead("start_ms").over(w) - F.col("end_ms")})
    judged = near.withColumn("rules", violated(F.col("w"), F.col("_right"), p))
    rank = F.when(T.ends_sentence(F.col("w")), 1).when(T.ends_clause(F.col("w")), 2).when(T.bare(F.col("_right")).isin(*p.conjunctions), 3).otherwise(4)
    cost = F.when(F.col("_right").isNotNull(), rule_cost(F.col("rules")) + rank - gap_bonus(F.col("gap_ms")))
    return judged.withColumn("break_cost", cost.cast("double")).drop("_right")


def best_lines(words: Column, p: LanguageProfile, limits: CardLimits = CardLimits()) -> Column:
    """One line, or two at the cut of least rule cost, then least difference, then longest top, then first; one over-long line if no cut fits."""
    text = F.array_join(words, " ")
    top = lambda i: F.array_join(F.slice(words, 1, i), " ")
    low = lambda i: F.array_join(F.slice(words, i + 1, 1_000_000), " ")
    cuts = F.filter(F.sequence(F.lit(1), F.size(words) - 1), lambda i: (F.length(top(i)) <= limits.line_chars) & (F.length(low(i)) <= limits.line_chars))
    keyed = F.transform(cuts, lambda i: F.struct(rule_cost(violated(F.get(words, i - 1), F.get(words, i), p)).alias("c"), F.abs(F.length(top(i)) - F.length(low(i))).alias("d"), (-F.length(top(i))).alias("t"), i.alias("i")))
    best = F.array_min(keyed)["i"]
    return F.when((F.length(text) <= limits.line_chars) | (F.size(words) < 2) | best.isNull(), F.array(text)).otherwise(F.array(top(best), low(best)))
