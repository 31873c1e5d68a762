"""What a language contributes: word lists, letters and rules, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LanguageProfile:
    name: str
    #: Letters written otherwise at the end of a word, and their usual form.
    finals: tuple[str, str]
    #: Letters that attach to the front of a word.
    prefixes: str
    object_marker: str
    function_words: tuple[str, ...]
    conjunctions: tuple[str, ...]
    units: tuple[str, ...]
    chains: tuple[tuple[str, str], ...]
    #: Letters that spelling may leave out.
    optional_letters: str
    #: Letters that take a mark, the marks, and the letters that may follow it.
    marked_letters: str
    marks: str
    letters: str
    confusions: tuple[str, ...]
    #: Whether a break between two Latin words counts against a card.
    latin_rule: bool


#: Fixed values of the Hebrew rules.
HEBREW = LanguageProfile(
    name="hebrew",
    finals=("ךםןףץ", "כמנפצ"),
    prefixes="בלכמשהו",
    object_marker="את",
    function_words=("ב", "ל", "מ", "ה", "ו", "כ", "ש", "של", "עם", "על", "כי", "אם", "אל", "מן", "לא", "גם", "או", "אז"),
    conjunctions=("אבל", "או", "אז", "כי", "וגם", "אלא"),
    units=("אחוז", "אחוזים", "מיליון", "מיליארד", "אלף", "אלפים", "מאות", "עשרות", "שקל", "שקלים", "דולר", "דולרים", "יום", "ימים", "שנה", "שנים", "שעה", "שעות", "דקה", "דקות", "חודש", "חודשים", "קילו", "מטר"),
    chains=(
        ("בית", "ספר"), ("בית", "חולים"), ("בית", "כנסת"), ("בית", "משפט"), ("מנהל", "שיווק"), ("עורך", "דין"), ("ראש", "ממשלה"), ("כדור", "רגל"), ("ברכת", "המזון"),
        ("תפילת", "הדרך"), ("עילוי", "נשמת"), ("בן", "אדם"), ("בני", "אדם"), ("בית", "דין"), ("יום", "כיפור"), ("ראש", "השנה"), ("שם", "הטוב"), ("סדר", "היום"),
    ),
    optional_letters="וי",
    marked_letters="גזצץ",
    marks="'׳’",
    letters="א-ת",
    confusions=("אע", "כחק", "סשצ", "טת", "בו", "דז", "הא"),
    latin_rule=True,
)

LATIN = LanguageProfile(
    name="latin",
    finals=("ſ", "s"),
    prefixes="dlsm",
    object_marker="que",
    function_words=("the", "of", "to", "a", "de", "la", "le", "der", "die", "in"),
    conjunctions=("and", "that", "et", "und", "y", "or"),
    units=("percent", "euro", "euros", "tion", "ment", "ing"),
    chains=(("of", "the"), ("in", "the"), ("de", "la"), ("to", "the")),
    optional_letters="iy",
    marked_letters="gzrs",
    marks="'’",
    letters="a-z",
    confusions=("ck", "sz", "iy", "ou", "dt", "bp", "vw"),
    latin_rule=False,
)

PROFILES = {p.name: p for p in (HEBREW, LATIN)}

#: Rule ids with their weights, and bonuses for a pause before the next word, in milliseconds.
RULE_WEIGHTS = {"et_split": 1, "function_word_line_end": 1, "construct_chain_split": 4, "number_unit_split": 4, "english_phrase_split": 4}
GAP_BONUS = ((100, 3.0), (50, 2.5), (20, 1.5))
SENTENCE_FINAL = ".?!…"
CLAUSE_PUNCT = ",;:"
#: Warning codes and edit reasons.
WARNING_CODES = ("timing_clamped", "cps_exceeded", "card_too_short", "line_too_long", "hebrew_rule_violation", "llm_rejected", "edit_budget_hit", "gap_not_applied")
EDIT_REASONS = ("glossary", "punctuation", "llm", "second_opinion")


#: The defaults of both are fixed values.
@dataclass(frozen=True)
class CardLimits:
    """How cards may look; durations in milliseconds."""

    target_chars: int = 14
    headroom: int = 0
    line_chars: int = 40
    lines: int = 2
    max_ms: int = 6000
    min_ms: int = 400
    max_cps: float = 25.0
    card_penalty: float = 0.5
    over_target_cost: float = 1.5

    @property
    def ceiling(self) -> int:
        return min(self.target_chars + self.headroom, self.lines * self.line_chars)


@dataclass(frozen=True)
class CorrectionLimits:
    fuzzy_threshold: float = 0.82
    min_fuzzy_length: int = 3
    #: Letters are what the similarity counts; with this, UTF-8 bytes for edits over letters for length, as DuckDB's levenshtein does in the queries' SQL.
    fuzzy_in_bytes: bool = False
    conf_threshold: float = 0.99
    edit_budget: float = 0.15
    max_edit_ratio: float = 0.60
    passes: tuple[str, ...] = field(default=("glossary",))
