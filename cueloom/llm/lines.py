"""Line deduplication by distinct-site spread, in DataFrame functions only.

A HyperLogLog sketch of the sites is built for each line (by the hash of the trimmed line) and merged by aggregation; each map
task sends one sketch a line, so a line on every page costs no more than any other. Lines whose estimate is clearly at or over
``min_sites`` are boilerplate, those clearly under it are not, and the lines between get an exact distinct count. Boilerplate
lines are then cut from the texts.

The query cuts every boilerplate line, whatever else a document holds; a document of nothing else becomes empty. Copies of whole pages
on many sites also have their lines on many sites. With ``spare``, a share of a document's characters, a document of which
boilerplate makes up so much keeps its text, and near-duplicate removal decides on it: the pipeline spares at 0.8, the
similarity at which that stage takes texts for copies. Blank lines are never boilerplate. A null text stays null with no lines; a null
site counts as one site of its own. Rows are matched by a hash of id and text, so repeated rows, null ids and ties are harmless:
a line is cut only where its own hash stands at its place. The lines are written once to the checkpoint folder. The joins on the
line hash are salted, for one line may be in a third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import SPACE, let

MIN_SITES = 10
#: 2^10 registers: a relative standard error of 3.3 %.
LG_K = 10
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)
SALTS = 64
NO_SITE = "\x00no site"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) == ""


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """row_key, site, line_key and pos of each line that is not blank."""
    text = F.col(f"`{text_col}`")
    each = docs.select(
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("row_key"),
        F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit(NO_SITE)).alias("site"),
        F.posexplode(F.transform(F.split(text, "\n"), lambda x: F.when(~_blank(x), _key(x)))).alias("pos", "line_key"),
    )
    return common.checkpointed(each.filter(F.col("line_key").isNotNull()))


def _salted(df: DataFrame, by: Column) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.hash(by), F.lit(SALTS)))


def _all_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_key and n_sites of the lines on at least min_sites sites; n_sites is exact near the threshold and an estimate above."""
    sketched = lines.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    estimated = sketched.select("line_key", F.hll_sketch_estimate("sketch").alias("n_sites"))
    low, high = min(min_sites - 1, int(min_sites * (1 - MARGIN))), max(min_sites + 1, int(min_sites * (1 + MARGIN)) + 1)
    seen = estimated.filter(F.col("n_sites") >= low)
    sure = seen.filter(F.col("n_sites") >= high)
    near = seen.filter(F.col("n_sites") < high).select("line_key")
    pairs = _salted(lines.select("line_key", "site", "row_key"), F.col("row_key")).join(_all_salts(near), ["line_key", "salt"], "left_semi").select("line_key", "site")
    exact = pairs.distinct().groupBy("line_key").agg(F.count(F.lit(1)).alias("n_sites")).filter(F.col("n_sites") >= min_sites)
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", spare: float | None = None) -> DataFrame:
    """docs with its columns, text without boilerplate lines, and n_lines and n_removed (lines that are not blank, and those cut)."""
    judged = _judged(docs, min_sites, id_col, text_col, site_col)
    cuts = F.lit(True) if spare is None else F.col("p.all") - F.col("p.left") < F.lit(spare) * F.col("p.all")
    return _cut(judged, docs.columns, text_col, cuts)


def _judged(docs: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """_row, _text and p: lines that are not blank (n), those that stay (m), characters (all), those that stay (left) and the text that stays."""
    lines = _lines(docs, id_col, text_col, site_col)
    found = boilerplate(lines, min_sites).select("line_key")
    marked = _salted(lines.select("row_key", "line_key", "pos"), F.col("row_key")).join(_all_salts(found), ["line_key", "salt"])
    cut = marked.groupBy("row_key").agg(F.collect_set(F.struct("pos", "line_key")).alias("cut"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("row_key")
    )
    parts = common.TEXT_PARTS * common.shuffle_width(docs.sparkSession)
    met = rows.repartition(parts, "row_key").join(cut.repartition(parts, "row_key").hint("merge"), "row_key", "left")

    def told(ls: Column) -> Column:
        said = F.size(F.filter(ls, lambda x: ~_blank(x))).cast("long")
        gone = F.transform(F.filter("cut", lambda c: _key(F.get(ls, c["pos"])) == c["line_key"]), lambda c: c["pos"])
        # Sets of places, so that a long page with many lines cut takes linear time.
        kept = F.when(F.size("cut") > 0, F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i))).otherwise(ls)
        return let(kept, lambda k: F.struct(said.alias("n"), F.size(F.filter(k, lambda x: ~_blank(x))).cast("long").alias("m"), _chars(ls).alias("all"), _chars(k).alias("left"), F.array_join(k, "\n").alias("text")))

    return met.select("_row", "_text", let(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"), told).alias("p"))


def _cut(done: DataFrame, columns: list[str], text_col: str, cuts: Column) -> DataFrame:
    text = F.col("_text")
    new = F.when(text.isNull(), F.lit(None).cast("string")).when(cuts, F.col("p.text")).otherwise(text)
    own = [new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return done.select(*own, F.col("p.n").alias("n_lines"), F.when(cuts, F.col("p.n") - F.col("p.m")).otherwise(F.lit(0).cast("long")).alias("n_removed"))


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(F.btrim(x, F.lit(SPACE))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keep_columns(common.table(spark, sf_dir, "documents"), ["doc_id", "text", "source"])
    return remove_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


#: Cuts boilerplate from `source`; gives line_cut(rid, ..., new_text, n_lines, n_removed).
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
LINES_SQL = f"""
docs6 AS (SELECT row_number() OVER () AS rid, * FROM {{source}}),
line6 AS (SELECT rid, site, i, l[i] AS line, {TRIM.format("l[i]")} AS bare FROM (
    SELECT rid, coalesce(source, chr(1)) AS site, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs6)),
boiler6 AS (SELECT bare FROM line6 WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
mark6 AS (SELECT line6.*, line6.bare <> '' AND boiler6.bare IS NOT NULL AS bad FROM line6 LEFT JOIN boiler6 ON line6.bare = boiler6.bare),
part6 AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS kept, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bad) AS n_bad FROM mark6 GROUP BY rid),
cut6 AS (SELECT docs6.* EXCLUDE (rid), CASE WHEN docs6.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS new_text, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_removed
    FROM docs6 LEFT JOIN part6 ON docs6.rid = part6.rid)"""
SQL = f"WITH {LINES_SQL.format(source='documents')} SELECT doc_id, new_text AS text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed FROM cut6"

QUERIES = {"op6_line_dedup": query}
ORACLES = {"op6_line_dedup": SQL}
