"""String functions of the transcript domain. The normalisers differ on purpose and are not interchangeable.

Accents: Spark has no canonical decomposition. ``fold_accents`` maps every precomposed Latin letter that decomposes to one base
letter and drops combining marks, which is exact for Hebrew and for Latin up to U+024F; ``fold_accents_exact`` is the Arrow
function for other scripts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..profiles import CLAUSE_PUNCT, SENTENCE_FINAL, LanguageProfile

RLM, RLE, LRI, PDI, PDF = "‏", "‫", "⁦", "⁩", "‬"
SPACES = r"(?U)\s+"


def _precomposed() -> tuple[str, str]:
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_precomposed()), r"\p{Mn}", "")


@F.pandas_udf(StringType())
def fold_accents_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def tokens(c: Column) -> Column:
    """Words between white space, empty ones left out."""
    return F.filter(F.split(c, SPACES), lambda x: x != "")


def unify_finals(c: Column, p: LanguageProfile) -> Column:
    return F.translate(c, *p.finals)


def words_for_scoring(c: Column, p: LanguageProfile) -> Column:
    """Punctuation parts words here."""
    return tokens(unify_finals(F.regexp_replace(fold_accents(c), r"\p{P}", " "), p))


def for_match(c: Column, p: LanguageProfile) -> Column:
    """Punctuation vanishes here."""
    return unify_finals(F.regexp_replace(fold_accents(c), r"\p{P}", ""), p)


def for_diff(c: Column, p: LanguageProfile) -> Column:
    return F.trim(for_match(c, p))


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{P}", "")


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(fold_accents(c), r"\p{P}", "")


def stem(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*?)(\p{P}*)$", 1)


def trailing_marks(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*?)(\p{P}*)$", 2)


def punctuation_tags(c: Column, p: LanguageProfile) -> Column:
    """(bare, marks) of each word that is not only punctuation."""
    pairs = F.transform(tokens(fold_accents(c)), lambda t: F.struct(unify_finals(bare(stem(t)), p).alias("bare"), trailing_marks(t).alias("marks")))
    return F.filter(pairs, lambda x: x["bare"] != "")


def variants(word: Column, p: LanguageProfile) -> Column:
    """The word, and without its first letter where that may be attached."""
    attached = (F.length(word) >= 3) & F.substring(word, 1, 1).isin(*p.prefixes)
    return F.when(attached, F.array(word, F.substring(word, 2, 1_000_000))).otherwise(F.array(word))


def match_variants(word: Column, p: LanguageProfile) -> Column:
    return variants(for_match(word, p), p)


def skeleton(c: Column, p: LanguageProfile) -> Column:
    return F.translate(c, p.optional_letters, "")


def ends_sentence(c: Column) -> Column:
    return c.rlike(f"[{SENTENCE_FINAL}]\\s*$")


def ends_clause(c: Column) -> Column:
    return c.rlike(f"[{CLAUSE_PUNCT}]\\s*$")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def clock(ms: Column, sep: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds; less than nothing counts as nothing."""
    t = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", (t / 3_600_000).cast("long"), ((t % 3_600_000) / 60_000).cast("long"), ((t % 60_000) / 1000).cast("long"), t % 1000)


def minutes(ms: Column) -> Column:
    t = F.greatest((ms / 1000).cast("long"), F.lit(0).cast("long"))
    return F.format_string("%d:%02d", (t / 60).cast("long"), t % 60)


def timecode(frame: Column, fps: Column) -> Column:
    """HH:MM:SS:FF at the rounded rate."""
    rate = F.greatest(F.round(fps).cast("long"), F.lit(1).cast("long"))
    f = frame.cast("long")
    s = (f / rate).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60, f % rate)


def timecode_at(ms: Column, fps: Column, start_frame: Column) -> Column:
    return timecode(start_frame + F.round(ms * fps / 1000).cast("long"), fps)


def display_line(line: Column) -> Column:
    """Sentence punctuation off the end of each word; a word of nothing else stays."""
    return F.array_join(F.transform(tokens(line), lambda t: F.when(F.regexp_replace(t, "[.,;:…]+$", "") == "", t).otherwise(F.regexp_replace(t, "[.,;:…]+$", ""))), " ")


def isolate_latin(line: Column) -> Column:
    return F.regexp_replace(line, r"[A-Za-z0-9][A-Za-z0-9 .,'\-&/]*[A-Za-z0-9]|[A-Za-z]", f"{LRI}$0{PDI}")


def anchor_right(line: Column) -> Column:
    return F.concat(F.lit(RLM), F.regexp_replace(line, "([.?!،,:;…]+)$", f"{RLM}$1"))


def decorate(line: Column, strip: bool = False, isolate: bool = False, rlm: bool = False) -> Column:
    """In this order: strip, isolate, anchor."""
    for on, f in ((strip, display_line), (isolate, isolate_latin), (rlm, anchor_right)):
        line = f(line) if on else line
    return line


def embed_right(c: Column) -> Column:
    """Right-to-left embedding, once."""
    return F.when(c.startswith(RLE), c).otherwise(F.concat(F.lit(RLE), c, F.lit(PDF)))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def rewrite_first(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (pattern, replacement) that matches rewrites; else unchanged."""
    out = None
    for pattern, replacement in rules:
        hit = F.regexp_replace(c, pattern, replacement)
        out = F.when(c.rlike(pattern), hit) if out is None else out.when(c.rlike(pattern), hit)
    return c if out is None else out.otherwise(c)


def folder_name(project: Column, timeline: Column) -> Column:
    """One folder for a timeline of a project."""
    return F.concat_ws("__", slug(project), slug(timeline))
