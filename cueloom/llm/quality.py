"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures each text and evaluates every rule once: its row holds the measurements and ``fail_bits``, where bit k
tells that rule k fails. ``apply_policy`` turns the ledger into verdicts under a named version of the policy without touching
the text again, and ``ablation`` counts from the distinct bit patterns, through bitwise aggregation, what each rule rejects,
what it alone rejects, and what would be kept without it.

A null or empty text has no words and fails "too_few_words". Every input row gives one row, repeated rows included; other
columns are left out of the ledger and passed through by ``filter_documents``. Equal windows of three words are recognised by
a 64-bit hash within one text. Nothing is shuffled: all of it is one pass over the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\f\r"
SPLIT = r"[ \x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    name: str
    #: True of the measurements when the text fails; whole numbers only, so that every engine agrees.
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)
BASE = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]
    #: Rejected when so many of its rules fail.
    at_least: int = 1

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", BASE),
        Policy("strict-1", tuple(r.name for r in RULES)),
        Policy("two-of-any-1", tuple(r.name for r in RULES), 2),
    )
}
CURRENT = "strict-1"
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words in windows of WINDOW words that occur at least twice in the array."""

    def hashed(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - F.lit(WINDOW))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        return F.transform(F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"])

    def union(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + F.lit(WINDOW)).alias("end"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    found = let(words, lambda ws: let(F.sort_array(hashed(ws)), lambda s: F.sort_array(F.filter(twice(s), lambda i: i.isNotNull()))))
    return F.when(F.size(words) > F.lit(WINDOW), union(found)).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, MEASUREMENTS and fail_bits."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    measured = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _covered(ws).alias("r"))).alias("w"),
        let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d"))).alias("l"),
        F.length(F.regexp_replace(text, SPLIT, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    ).select(id_col, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals")
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed, kept and policy."""
    p = POLICIES[version]
    hit = F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")))
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base-1"].mask).cast("long")) != 0
    return ledger_df.withColumns({"base_failed": base, "kept": ~base & (hit < p.at_least), "policy": F.lit(version)})


def ablation(ledger_df: DataFrame, version: str = CURRENT) -> DataFrame:
    """A row for each rule of the policy: how many documents it fails, how many no other rule fails, how many would be kept without it.

    The documents are first counted by bit pattern (at most 2 to the number of rules), so that only those counts are shuffled.
    """
    p = POLICIES[version]
    by_bits = ledger_df.groupBy("fail_bits").count()
    rules = [(i, r.name) for i, r in enumerate(RULES) if r.name in p.rules]
    in_policy = F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long"))
    one = [
        F.struct(
            F.lit(name).alias("rule"),
            (in_policy.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias("fails"),
            (in_policy == F.lit(1 << i).cast("long")).alias("alone"),
            (F.bit_count(in_policy.bitwiseAND(F.lit(~(1 << i)).cast("long"))) < p.at_least).alias("kept"),
        )
        for i, name in rules
    ]
    each = by_bits.select("count", F.explode(F.array(*one)).alias("x")).select("count", "x.*")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("count"))), F.lit(0)).alias(f"n_{c}")
    return each.groupBy("rule").agg(total("fails"), total("alone"), total("kept"))


def filter_documents(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the policy keeps; each row is judged by its own text."""
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    judged = apply_policy(ledger(tagged, "_row", "_text"), version).filter("kept")
    return judged.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "fail_bits")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(common.table(spark, sf_dir, "documents")))


def _bits_sql() -> str:
    return " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))


LEDGER_SQL = rf"""
base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {{source}}),
ws AS (SELECT rid, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
              list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM base),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM ws)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM dup) GROUP BY rid),
measured AS (SELECT b.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
       FROM base b JOIN ws ON ws.rid = b.rid LEFT JOIN cov ON cov.rid = b.rid),
judged AS (SELECT *, CAST({_bits_sql()} AS BIGINT) AS fail_bits FROM measured)"""
#: The current policy rejects at one failure of any rule.
SQL = f"""WITH {LEDGER_SQL.format(source="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES["base-1"].mask}) <> 0 AS base_failed,
       (fail_bits & {POLICIES[CURRENT].mask}) = 0 AS kept, n_lines, n_capitals, fail_bits FROM judged"""
ABLATION_SQL = f"WITH {LEDGER_SQL.format(source='documents')}, cnt AS (SELECT fail_bits, count(*) AS c FROM judged GROUP BY fail_bits)\n" + "\nUNION ALL ".join(
    f"SELECT '{r.name}' AS rule, CAST(coalesce(sum(c) FILTER (fail_bits & {1 << i} <> 0), 0) AS BIGINT) AS n_fails, CAST(coalesce(sum(c) FILTER (fail_bits = {1 << i}), 0) AS BIGINT) AS n_alone, CAST(coalesce(sum(c) FILTER (fail_bits & {(1 << len(RULES)) - 1 - (1 << i)} = 0), 0) AS BIGINT) AS n_kept FROM cnt"
    for i, r in enumerate(RULES)
)

QUERIES = {"op2_quality": query, "quality_ablation": ablation_query}
ORACLES = {"op2_quality": SQL, "quality_ablation": ABLATION_SQL}
