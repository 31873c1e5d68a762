"""Queries for the operators that the first catalogue leaves out: passes over words, recognisers compared, display text, subtitle files, documents, histories, and the Hebrew rules.

They register beside the others. Files are given as tables of (job_id, raw), as the readers make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, breaks, contract, display, glossary, guards, history, metrics, rewrite, segmenter, spans
from ..profiles import GAP_BONUS, HEBREW, RULE_WEIGHTS, CorrectionLimits, LanguageProfile
from ..sources import files
from ..sources import words as S
from ..storage import kept
from . import catalogue as C
from .catalogue import CARDS, COST, LEX, LISTS, P, SEGMENT, SHOWN, STEM, TERMS, WORDS, _quote, fold, query, words

FLAGS = "flags AS (SELECT job_id, wid, start_ms, w AS heard, translate(w, 'aeiou', 'eioua') AS alternative FROM words WHERE wid % 17 = 0 AND translate(w, 'aeiou', 'eioua') <> w)"


def flagged(ws: DataFrame) -> DataFrame:
    """Every 17th word, heard otherwise."""
    other = F.translate("w", "aeiou", "eioua")
    return ws.filter("wid % 17 = 0").select("job_id", "wid", "start_ms", F.col("w").alias("heard"), other.alias("alternative")).filter("heard <> alternative")


# --- passes over words ----------------------------------------------------------------------------------------------------

#: The best term of each stem that no mapping knows, and the mapping of the others.
_V = C.VARIANTS.format("f")
BETTER = rf"""{WORDS}, {LISTS}, sp AS (SELECT *, {STEM.format('w', 1)} AS stem, {STEM.format('w', 2)} AS marks FROM words), st AS (SELECT DISTINCT stem, {fold('stem')} AS f FROM sp WHERE stem <> ''),
ex AS (SELECT stem, arg_min("right", n) AS better FROM (SELECT stem, unnest({_V}) AS norm, unnest(range(0, len({_V}))) AS n FROM st) v JOIN mappings ON v.norm = mappings.norm GROUP BY stem),
op AS (SELECT * FROM st WHERE length(f) >= 3 AND stem NOT IN (SELECT stem FROM ex) AND NOT EXISTS (SELECT 1 FROM terms WHERE list_contains({_V}, norm))),
sc AS (SELECT stem, term, ord, 1 - levenshtein(f, norm) / greatest(length(f), length(norm)) AS score FROM op, terms),
better AS (SELECT * FROM ex UNION ALL SELECT stem, term FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY score DESC, ord) AS r FROM sc) WHERE r = 1 AND score >= {CorrectionLimits().fuzzy_threshold}),
glossed AS (SELECT job_id, wid, w AS before, coalesce(better, sp.stem) || marks AS after, 'glossary' AS reason FROM sp LEFT JOIN better ON better.stem = sp.stem)"""

#: Where two recognisers differ, runs of words that are changed or left out; a run without one left out is heard otherwise word for word.
RUNS = f"""{C.TEXTS}, al AS (SELECT words.job_id, words.wid, words.start_ms, words.w AS heard, hyp.w AS alternative, CASE WHEN hyp.w IS NULL THEN 'gone' WHEN trim({fold('words.w')}) = trim({fold('hyp.w')}) THEN 'same' ELSE 'changed' END AS state
  FROM words LEFT JOIN hyp ON hyp.job_id = words.job_id AND hyp.wid = words.wid),
rn AS (SELECT *, wid - row_number() OVER (PARTITION BY job_id, state = 'same' ORDER BY wid) AS run FROM al),
review AS (SELECT job_id, wid, start_ms, heard, alternative FROM (SELECT *, count(*) FILTER (state = 'gone') OVER (PARTITION BY job_id, run, state = 'same') AS gone FROM rn) WHERE state = 'changed' AND gone = 0)"""
_REAL = f"""CASE WHEN trim({fold('{0}')}) = '' THEN false ELSE regexp_matches(trim({fold('{0}')}), '[^a-z]') OR trim({fold('{0}')}) IN (SELECT word FROM lexicon)
  OR (length(trim({fold('{0}')})) > 2 AND substring(trim({fold('{0}')}), 1, 1) {C._IN_PRE} AND substring(trim({fold('{0}')}), 2) IN (SELECT word FROM lexicon))
  OR (length(trim({fold('{0}')})) > 3 AND substring(trim({fold('{0}')}), 1, 1) {C._IN_PRE} AND substring(trim({fold('{0}')}), 2, 1) {C._IN_PRE} AND substring(trim({fold('{0}')}), 3) IN (SELECT word FROM lexicon)) END"""


def _real(c: str) -> str:
    return _REAL.replace("{0}", c)


RESOLVED = f"{RUNS}, {LEX}, resolved AS (SELECT job_id, wid, heard AS before, alternative AS after, 'second_opinion' AS reason FROM review WHERE NOT {_real('heard')} AND {_real('alternative')})"

C.SQL["glossary_pass"] = f"WITH {BETTER} SELECT * FROM glossed WHERE after <> before"
C.SQL["review_disagreements"] = f"WITH {RUNS} SELECT job_id, wid, start_ms, trim(heard) AS heard, trim(alternative) AS alternative FROM review"
C.SQL["resolve_disagreements"] = f"WITH {RESOLVED} SELECT * FROM resolved"
C.SQL["edit_reason_counts"] = f"WITH {RESOLVED}, {BETTER.replace(WORDS + ', ', '')}, e AS (SELECT job_id, reason FROM resolved UNION ALL SELECT job_id, reason FROM glossed WHERE after <> before) SELECT job_id, reason, count(*) AS n FROM e GROUP BY ALL"

_NORMED = f"{C.TEXTS}, nr AS (SELECT words.job_id, words.wid, trim({fold('words.w', ' ')}) AS r, trim({fold('hyp.w', ' ')}) AS h FROM words LEFT JOIN hyp ON hyp.job_id = words.job_id AND hyp.wid = words.wid)"
_BARE = lambda c: f"regexp_replace({c}, '[iy]', '', 'g')"
#: Words of both sides meet by number; a word with no letters left is no word.
C.SQL["wer_difflib"] = f"""WITH {_NORMED} SELECT job_id, count(*) FILTER (r IS DISTINCT FROM h AND r <> '') / count(*) FILTER (r <> '') AS wer, count(*) FILTER ({_BARE('r')} IS DISTINCT FROM {_BARE('h')} AND r <> '') / count(*) FILTER (r <> '') AS wer_tolerant FROM nr GROUP BY job_id"""
#: Least edits in a band around the diagonal: row i holds the distances of the first i words to the first i - BAND to i + 4 of the other side.
_BAND = 16
C.SQL["wer_levenshtein"] = f"""WITH RECURSIVE {C.TEXTS},
sq AS (SELECT job_id, list(t ORDER BY wid) AS a FROM (SELECT job_id, wid, trim({fold('w', ' ')}) AS t FROM words) WHERE t <> '' GROUP BY job_id),
oq AS (SELECT job_id, list(t ORDER BY wid) AS b FROM (SELECT job_id, wid, trim({fold('w', ' ')}) AS t FROM hyp) WHERE t <> '' GROUP BY job_id),
ed AS (SELECT sq.job_id, a, b, 0 AS i, list_transform(range(0, {_BAND + 5}), lambda k: CASE WHEN k - {_BAND} >= 0 THEN k - {_BAND} ELSE 1000000 END) AS row FROM sq JOIN oq ON oq.job_id = sq.job_id
UNION ALL SELECT job_id, a, b, i + 1, list_transform(range(0, {_BAND + 5}), lambda k: list_min(list_transform(range(0, k + 1), lambda m: c[m + 1] + k - m))) FROM (
  SELECT *, list_transform(range(0, {_BAND + 5}), lambda k: CASE WHEN i + 1 + k - {_BAND} < 0 OR i + 1 + k - {_BAND} > len(b) THEN 1000000 WHEN i + 1 + k - {_BAND} = 0 THEN i + 1
    ELSE least(row[k + 1] + CASE WHEN a[i + 1] = b[i + 1 + k - {_BAND}] THEN 0 ELSE 1 END, coalesce(row[k + 2], 1000000) + 1) END) AS c FROM ed) WHERE i < len(a))
SELECT job_id, row[len(b) - len(a) + {_BAND + 1}] / len(a) AS wer FROM ed WHERE i = len(a)"""

_TAGS = lambda c: (f"regexp_replace({STEM.format(c, 1)}, '\\p{{P}}', '', 'g')", STEM.format(c, 2))
_R, _H = _TAGS("f"), _TAGS("g")
C.SQL["punct_f1"] = f"""WITH {C.TEXTS}, pr AS (SELECT words.job_id, translate(strip_accents(words.w), 'ſ', 's') AS f, translate(strip_accents(regexp_replace(hyp.w, '([A-Za-z0-9_]{{5}}),', '\\1', 'g')), 'ſ', 's') AS g FROM words LEFT JOIN hyp ON hyp.job_id = words.job_id AND hyp.wid = words.wid),
tg AS (SELECT job_id, {_R[0]} AS a, {_R[1]} AS m, {_H[0]} AS b, {_H[1]} AS n FROM pr), eq AS (SELECT job_id, m, CASE WHEN a = b THEN n END AS n, a FROM tg WHERE a <> ''),
ct AS (SELECT job_id, count(*) FILTER (m <> '') AS marked, count(*) FILTER (m <> '' AND m = n) AS same, count(*) FILTER (n <> '' AND m <> n) AS wrong, count(*) FILTER (m <> '' AND m <> n) AS missed FROM eq GROUP BY job_id)
SELECT job_id, CASE WHEN marked = 0 THEN NULL WHEN same = 0 THEN 0.0 ELSE 2 * same / (2 * same + wrong + missed) END AS f1 FROM ct"""

_TERMS = ", ".join(f"({_quote(t)})" for t in TERMS)
_ONE = lambda c: f"translate({c}, 'àâäáãåçèéêëìíîïñòóôöõùúûüýßœæÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝŒÆ', '!\"#$%&()*+,-./:;<=>?@[]^_`{{|}}~01234567890123456789012345')"
#: The order of the guards; a replacement that passes the others is taken while the segment's budget lasts. Accents stand for one byte each where edits are counted.
C.SQL["llm_guarded_apply"] = f"""WITH {WORDS}, {LISTS}, ask AS (SELECT job_id, seg, wid AS ord, CASE WHEN wid % 23 = 0 THEN wid + 100000 ELSE wid END AS wid, CASE WHEN wid % 5 = 0 THEN ',' WHEN wid % 5 = 1 THEN 'a' END AS append,
  CASE WHEN wid % 5 > 1 THEN CASE wid % 4 WHEN 0 THEN translate(w, 'ae', 'ea') WHEN 1 THEN w || ' x' WHEN 2 THEN 'z' ELSE {STEM.format('w', 1)} || 's' END END AS replacement FROM words WHERE wid % 9 = 4),
vouched AS (SELECT norm FROM terms UNION SELECT norm FROM mappings UNION SELECT {fold('"right"')} FROM mappings),
bud AS (SELECT job_id, seg, greatest(1, CAST(floor(count(*) * {CorrectionLimits().edit_budget}) AS BIGINT)) AS budget FROM words GROUP BY ALL),
j AS (SELECT ask.*, words.w AS before, words.conf, {STEM.format('words.w', 1)} AS stem, {STEM.format('words.w', 2)} AS marks, {fold(STEM.format('words.w', 1))} AS f FROM ask LEFT JOIN words ON words.job_id = ask.job_id AND words.seg = ask.seg AND words.wid = ask.wid),
g AS (SELECT *, CASE WHEN before IS NULL THEN 'not in this segment' WHEN append IS NOT NULL THEN CASE WHEN append = ',' THEN 'append' ELSE 'append is not punctuation' END WHEN trim(coalesce(replacement, '')) = '' THEN 'no replacement' WHEN replacement LIKE '% %' THEN 'more than one word'
  WHEN EXISTS (SELECT 1 FROM vouched WHERE list_contains({_V}, norm)) AND stem <> '' THEN 'protected by the glossary' WHEN conf >= {CorrectionLimits().conf_threshold} THEN 'confident'
  WHEN stem <> '' AND levenshtein({_ONE('stem')}, {_ONE('replacement')}) > {CorrectionLimits().max_edit_ratio} * length(stem) THEN 'far' ELSE 'near' END AS verdict FROM j),
n AS (SELECT g.*, budget, coalesce(sum(CASE WHEN verdict = 'near' THEN 1 ELSE 0 END) OVER (PARTITION BY g.job_id, g.seg ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM g JOIN bud ON bud.job_id = g.job_id AND bud.seg = g.seg),
h AS (SELECT *, verdict IN ('near', 'far') AND done >= budget AS over FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY job_id, seg, over ORDER BY ord) AS r FROM h)
SELECT job_id, seg, ord, wid, CASE WHEN over THEN CASE WHEN r = 1 THEN 'edit_budget_hit' ELSE 'dropped' END WHEN verdict = 'near' THEN 'llm' WHEN verdict = 'append' THEN 'punctuation' ELSE 'llm_rejected' END AS kind, before,
  CASE WHEN over THEN NULL WHEN verdict = 'near' THEN replacement || marks WHEN verdict = 'append' THEN before || append END AS after, CASE WHEN over OR verdict IN ('near', 'append') THEN NULL WHEN verdict = 'far' THEN 'a rewrite' ELSE verdict END AS detail FROM k"""

NUMBERED = f"WITH RECURSIVE {SEGMENT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY first_wid) - 1 AS card, round(length(text) * 1000.0 / (end_ms - start_ms), 3) AS cps FROM best_cards)"
_RULED = "unnest(range(0, len(cost.rules))) + 1000 AS ord, 'hebrew_rule_violation' AS code, unnest(list_transform(cost.rules, lambda r: r || ': ')) || w || ' ' || nw AS detail, cost.wid AS wid_start, cost.wid + 1 AS wid_end"


def warnings_sql(cards: str = "numbered") -> str:
    """Warnings of cards of one line each."""
    return f"""warned AS (SELECT job_id, card, 0 AS ord, 'card_too_short' AS code, CAST(end_ms - start_ms AS VARCHAR) AS detail, first_wid AS wid_start, last_wid AS wid_end FROM {cards} WHERE end_ms - start_ms < 400
UNION ALL SELECT job_id, card, CASE WHEN end_ms - start_ms < 400 THEN 1 ELSE 0 END, 'cps_exceeded', CAST(cps AS VARCHAR), first_wid, last_wid FROM {cards} WHERE cps > 25.0
UNION ALL SELECT job_id, card, CASE WHEN end_ms - start_ms < 400 THEN 1 ELSE 0 END + CASE WHEN cps > 25.0 THEN 1 ELSE 0 END, 'line_too_long', text, first_wid, last_wid FROM {cards} WHERE length(text) > 40
UNION ALL SELECT c.job_id, card, {_RULED} FROM cost JOIN {cards} c ON c.job_id = cost.job_id AND c.last_wid = cost.wid)"""


C.SQL["card_warnings"] = f"{NUMBERED}, {warnings_sql()} SELECT job_id, card, CAST(ord AS INT) AS ord, code, detail, wid_start, wid_end FROM warned"
C.SQL["cut_list_fingerprint"] = f"""WITH {WORDS}, it AS (SELECT job_id, sha256('{{"track":1,"timeline_start_ms":' || start_ms || ',"duration_ms":' || (end_ms - start_ms) || ',"path":"clip' || seg || '","source_in_ms":0}}') AS h FROM words WHERE pos = 0)
SELECT job_id, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint FROM it GROUP BY job_id"""


@query(f"WITH {WORDS}, {FLAGS} SELECT job_id, wid, heard, alternative, greatest(count(*) OVER (PARTITION BY job_id) - 10, 0) AS more FROM flags QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY wid) <= 10")
def review_report(spark: SparkSession, d: str) -> DataFrame:
    """The first ten flags of a job, and how many more there are."""
    return metrics.review_report(flagged(words(spark, d))).select("job_id", "wid", "heard", "alternative", "more")


@query(f"WITH {CARDS}, {FLAGS} SELECT f.job_id, card, wid, c.start_ms, c.end_ms, heard || chr(10) || alternative AS text FROM flags f JOIN cards c ON c.job_id = f.job_id AND f.wid BETWEEN first_wid AND last_wid")
def review_cards(spark: SparkSession, d: str) -> DataFrame:
    ws = words(spark, d)
    return display.review_cards(C.simple_cards(ws), flagged(ws))


@query(f"WITH {WORDS}, {FLAGS}, m AS (SELECT *, CAST(round(start_ms * 0.4 / 1000) AS BIGINT) AS f0 FROM flags), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, f0 ORDER BY wid) - 1 AS k FROM m) SELECT job_id, wid, f0 + k AS frame FROM n WHERE k <= 3")
def marker_frames(spark: SparkSession, d: str) -> DataFrame:
    """At so few frames a second several flags fall on one."""
    return display.markers(flagged(words(spark, d)), F.lit(0.4)).select("job_id", "wid", "frame")


@query(f"WITH {WORDS}, segs AS (SELECT job_id, seg, string_agg(w, ' ' ORDER BY wid) AS text FROM words GROUP BY ALL) SELECT job_id, seg, concat_ws('|', lag(text, 2) OVER w, lag(text) OVER w) AS before, concat_ws('|', lead(text) OVER w, lead(text, 2) OVER w) AS after FROM segs WINDOW w AS (PARTITION BY job_id ORDER BY seg)")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return guards.context(rewrite.segments(words(spark, d))).select("job_id", "seg", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"WITH {BETTER} SELECT job_id, wid, start_ms, end_ms FROM words WHERE wid % 40 = 3 UNION ALL SELECT job_id, wid, start_ms, end_ms + 1 FROM words WHERE wid % 40 = 3")
def shape_changes(spark: SparkSession, d: str) -> DataFrame:
    """The glossary pass keeps all places and times; of a pass that does not, each change is found."""
    ws = kept(words(spark, d))
    passed = glossary.apply(ws, *C.lists(spark), P)[0].withColumn("end_ms", F.col("end_ms") + (F.col("wid") % 40 == 3).cast("long"))
    return contract.shape_preserved(ws, passed).select("job_id", "wid", "start_ms", "end_ms")


_TRACKS = f"""said AS (SELECT conv_id % 5 AS track, unnest(regexp_extract_all(trim({fold('text')}), '[a-z]+')) AS word FROM conversations), tracks AS (SELECT DISTINCT track, word FROM said WHERE length(word) > 1),
mine AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(trim({fold('text')}), '[a-z]+')) AS word FROM conversations WHERE role = 'user') WHERE length(word) > 1),
share AS (SELECT track, count(*) / (SELECT count(*) FROM mine) AS share FROM tracks WHERE word IN (SELECT word FROM mine) GROUP BY track),
best AS (SELECT track, share FROM share WHERE share >= 0.1 ORDER BY share DESC, track LIMIT 1)"""


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select((F.col("conv_id") % 5).alias("track"), "text"), c.filter("role = 'user'").select("text")


@query(f"WITH {_TRACKS} SELECT track, round(share, 6) AS share FROM best")
def track_choice(spark: SparkSession, d: str) -> DataFrame:
    items, ours = _tracks(spark, d)
    runs = F.regexp_extract_all(T.for_diff(F.col("text"), P), F.lit(f"[{P.letters}]+"), 0)
    tracks = items.select("track", F.explode(runs).alias("word")).filter("length(word) > 1").distinct()
    return glossary.choose_track(tracks, glossary.learn_words(ours, P), 0.1).select("track", F.round("share", 6).alias("share"))


@query(f"WITH {LEX}, {_TRACKS}, new AS (SELECT DISTINCT word FROM tracks JOIN best ON best.track = tracks.track WHERE share >= 0.5 AND word NOT IN (SELECT word FROM mine) AND word NOT IN (SELECT word FROM lexicon)) SELECT 'learned' AS status, word FROM new UNION ALL SELECT 'no_match', NULL WHERE NOT EXISTS (SELECT 1 FROM best WHERE share >= 0.5)")
def correction_harvest(spark: SparkSession, d: str) -> DataFrame:
    items, ours = _tracks(spark, d)
    return glossary.harvest_corrections(items, ours, C.lexicon(spark, d), P)


@query(f"WITH {WORDS} SELECT job_id, seg, ord, wid, replacement, append FROM (SELECT job_id, seg, wid AS ord, wid, reverse(w) AS replacement, CAST(NULL AS VARCHAR) AS append FROM words WHERE wid % 6 = 1 AND length(w) >= 3 AND wid % 10 >= 4 AND (wid % 10) / 1000.0 >= 0.002)")
def scored_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A masked model's scores: two candidates a word, of which the likelier is proposed if it is likely enough."""
    p = (F.col("wid") % 10) / 1000.0
    ws = words(spark, d).filter("wid % 6 = 1")
    both = [ws.select("job_id", "seg", "wid", F.col("w").alias("heard"), c.alias("candidate"), q.alias("p"), F.lit(0.001).alias("p_heard")) for c, q in ((F.reverse("w"), p), (F.concat("w", F.lit("x")), p / 2))]
    return guards.candidates_to_proposals(both[0].unionByName(both[1]))


# --- display --------------------------------------------------------------------------------------------------------------

_LINE = C._DISPLAY
_LATIN_RUN = r"([A-Za-z0-9][A-Za-z0-9 .,''\-&/]*[A-Za-z0-9]|[A-Za-z])"
_ISOLATED = lambda c: f"regexp_replace({c}, '{_LATIN_RUN}', chr(8294) || '\\1' || chr(8297), 'g')"
_ANCHORED = lambda c: f"chr(8207) || regexp_replace({c}, '([.?!،,:;…]+)$', chr(8207) || '\\1')"


@query(f"WITH {CARDS} SELECT job_id, card, {_ISOLATED('text')} AS isolated, {_ANCHORED('text')} AS anchored, {_ANCHORED(_ISOLATED(f'array_to_string({_LINE}, {chr(39)} {chr(39)})'))} AS decorated, CASE WHEN starts_with(text, chr(8235)) THEN text ELSE chr(8235) || text || chr(8236) END AS embedded FROM cards")
def display_marks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return C.simple_cards(words(spark, d)).select("job_id", "card", T.isolate_latin(t).alias("isolated"), T.anchor_right(t).alias("anchored"), T.decorate(t, strip=True, isolate=True, rlm=True).alias("decorated"), T.embed_right(t).alias("embedded"))


_POINT = C._CLOCK.replace(",%03d", ".%03d")


@query(f"WITH {SHOWN}, closed AS (SELECT *, lead(shown_start) OVER (PARTITION BY job_id ORDER BY card) AS nx FROM shown), e AS (SELECT *, CASE WHEN nx - end_ms > 0 AND nx - end_ms <= 60 THEN nx ELSE end_ms END AS shown_end FROM closed) SELECT job_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_POINT.format('start_ms')} || ' --> ' || {_POINT.format('shown_end')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY card) AS text FROM e GROUP BY job_id")
def vtt_documents(spark: SparkSession, d: str) -> DataFrame:
    """Spoken starts, closed ends."""
    ws = words(spark, d)
    return display.document(display.vtt_blocks(display.ends(display.starts(C.simple_cards(ws), C.onset(ws)), close_ms=60)), display.VTT_HEAD)


@query(f"WITH {WORDS} SELECT job_id, wid, printf('%02d:%02d:%02d:%02d', f // 90000, f // 1500 % 60, f // 25 % 60, f % 25) AS code FROM (SELECT *, 90000 + CAST(round(start_ms * 25.0 / 1000) AS BIGINT) AS f FROM words)")
def timecode_of_words(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).select("job_id", "wid", T.timecode_at(F.col("start_ms"), F.lit(25.0), F.lit(90000)).alias("code"))


_SLUG = lambda c: f"CASE WHEN trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_') = '' THEN 'unnamed' ELSE trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_') END"


@query(f"WITH {CARDS} SELECT job_id, card, {_SLUG('text')} || '__' || {_SLUG('CAST(card AS VARCHAR)')} AS folder, CASE WHEN regexp_matches(text, '^(\\w+) (\\w+)') THEN regexp_replace(text, '^(\\w+) (\\w+)', '\\2 \\1') WHEN regexp_matches(text, 'e$') THEN regexp_replace(text, 'e$', 'E') ELSE text END AS told FROM cards")
def folders_and_logs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return C.simple_cards(words(spark, d)).select("job_id", "card", T.folder_name(t, F.col("card").cast("string")).alias("folder"), T.rewrite_first(t, [(r"^(\w+) (\w+)", "$2 $1"), ("e$", "E")]).alias("told"))


# --- subtitle files and documents -----------------------------------------------------------------------------------------


def _subtitles(spark: SparkSession, d: str) -> DataFrame:
    return C.Q["srt_documents"](spark, d).withColumnRenamed("text", "raw")


@query(f"WITH {CARDS} SELECT job_id, card AS ord, start_ms FROM cards")
def subtitle_starts(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles are written and read again."""
    return files.srt_starts(_subtitles(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {CARDS} SELECT job_id, card AS ord, text FROM cards")
def subtitle_texts(spark: SparkSession, d: str) -> DataFrame:
    return files.srt_cards(_subtitles(spark, d)).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {CARDS}, srt AS (SELECT job_id, string_agg(text, ' ' ORDER BY card) AS t FROM cards WHERE job_id % 3 > 0 GROUP BY job_id), own AS (SELECT DISTINCT job_id, 'own text' AS t FROM words WHERE job_id % 2 = 0) SELECT coalesce(own.job_id, srt.job_id) AS job_id, coalesce(own.t, srt.t) AS text, srt.t IS NOT NULL AS has_cuts FROM own FULL JOIN srt ON srt.job_id = own.job_id")
def reference_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text file wins for the text, subtitles give the cuts."""
    own = words(spark, d).filter("job_id % 2 = 0").select("job_id").distinct().withColumn("raw", F.lit("own text"))
    return files.references(own, _subtitles(spark, d).filter("job_id % 3 > 0"))


@query("SELECT DISTINCT conv_id AS job_id, conv_id % 4 = 1 AS referenced FROM conversations")
def media_with_reference(spark: SparkSession, d: str) -> DataFrame:
    media = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("job_id")).distinct()
    have, lack = files.split_media(media, media.filter("job_id % 4 = 1"))
    return have.withColumn("referenced", F.lit(True)).unionByName(lack.withColumn("referenced", F.lit(False)))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Transcript documents of the words, as text; some lack a key, some have one too many."""
    ws = words(spark, d)
    word = F.struct("wid", "w", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "conf")
    segs = ws.groupBy("job_id", "seg").agg(F.array_sort(F.collect_list(word)).alias("words"))
    seg = F.struct(F.col("seg").cast("long").alias("id"), F.col("words")[0]["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), F.array_join(F.transform("words", lambda x: x["w"]), " ").alias("text"), "words")
    made = segs.groupBy("job_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    meta = F.struct(*[F.lit(x).alias(c) for c, x in (("source_file", "a.wav"), ("language", "x"), ("engine", "e"), ("engine_version", "1"), ("created_at", ""))], F.lit(1.0).alias("duration"), F.array(F.lit("transcribe")).alias("stages"), F.array().cast(f"array<{files.WARNING}>").alias("warnings"))
    whole = F.to_json(F.struct(meta.alias("meta"), "segments", F.array().cast(f"array<{files.EDIT}>").alias("edits")))
    raw = F.when(F.col("job_id") % 9 == 2, F.regexp_replace(whole, ',"edits":\\[\\]', "")).when(F.col("job_id") % 9 == 5, F.regexp_replace(whole, '"engine":"e"', '"motor":"e"')).otherwise(whole)
    return made.select("job_id", raw.alias("raw"))


@query(f"WITH {WORDS} SELECT job_id, CAST(dense_rank() OVER (PARTITION BY job_id ORDER BY seg) - 1 AS INT) AS seg, pos, wid, w, start_ms, end_ms, conf FROM words")
def transcript_documents(spark: SparkSession, d: str) -> DataFrame:
    """Words written as documents in seconds and read again in milliseconds."""
    return files.transcript_words(files.parse_transcripts(_documents(spark, d)))


@query(f"WITH {WORDS} SELECT job_id, CAST(dense_rank() OVER (PARTITION BY job_id ORDER BY seg) - 1 AS INT) AS seg, pos, w, start_ms, end_ms, conf FROM words")
def recogniser_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same documents as a recogniser's output, which has no word numbers."""
    return files.parse_raw_words(_documents(spark, d))


@query("SELECT DISTINCT conv_id AS job_id, unnest(CASE WHEN conv_id % 9 = 2 THEN ['$'] WHEN conv_id % 9 = 5 THEN ['$.meta', '$.meta'] ELSE [] END) AS path, unnest(CASE WHEN conv_id % 9 = 2 THEN ['missing key edits'] WHEN conv_id % 9 = 5 THEN ['missing key engine', 'unexpected key motor'] ELSE [] END) AS problem FROM conversations WHERE text IS NOT NULL")
def unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    return files.unknown_keys(_documents(spark, d))


@query(f"""WITH {WORDS}, nb AS (SELECT *, dense_rank() OVER (PARTITION BY job_id ORDER BY seg) - 1 AS s FROM words WHERE job_id % 9 = 4), bad AS (SELECT *, '$.segments[' || s || '].words[' || pos || ']' AS path FROM nb)
SELECT job_id, path, 'wid is not a whole number' AS problem FROM bad WHERE wid IN (3, 5, 8) UNION ALL SELECT job_id, path, 'w is not a text' FROM bad WHERE wid = 7 UNION ALL SELECT job_id, path, 'conf is neither a number nor null' FROM bad WHERE wid = 9
UNION ALL SELECT job_id, path, 'start is not a number' FROM bad WHERE wid IN (11, 12) UNION ALL SELECT job_id, path, 'start has more than three decimals' FROM bad WHERE wid = 14 UNION ALL SELECT job_id, path, 'start is negative' FROM bad WHERE wid = 15""")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """Values of a wrong kind in transcript documents; a null confidence is none."""
    raw = F.col("raw")
    for pattern, new in (
        ('"wid":3,', '"wid":true,'), ('"wid":5,', '"wid":"5",'), ('"wid":8,', '"wid":8.5,'), ('"wid":7,"w":"[^"]*"', '"wid":7,"w":7'), ('("wid":9,[^}]*"conf":)[0-9.]+', '$1"high"'), ('("wid":10,[^}]*"conf":)[0-9.]+', "$1null"),
        ('("wid":11,[^}]*"start":)[0-9.]+', "$1false"), ('("wid":12,[^}]*"start":)[0-9.]+', '$1"1.5"'), ('("wid":14,[^}]*"start":)[0-9.]+', "$10.12345"), ('("wid":15,[^}]*"start":)[0-9.]+', "$1-1.5"),
    ):
        raw = F.regexp_replace(raw, pattern, new)
    return files.type_checks(_documents(spark, d).withColumn("raw", F.when(F.col("job_id") % 9 == 4, raw).otherwise(F.col("raw"))))


@query(f"""WITH {SHOWN}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY card) - end_ms AS gap FROM shown)
SELECT job_id, 'job ' || job_id AS source, count(*) AS cards, count(*) FILTER (cps > 25.0) AS cards_over_cps, max(cps) AS max_cps, round(avg(cps), 3) AS mean_cps, count(*) FILTER (gap > 0 AND gap <= 60) AS closed_gaps, arg_min(shown_start, card) > 0 AS timing_clip, CASE WHEN count(*) FILTER (card % 50 = 7) > 0 THEN 'gap_not_applied' END AS first_code FROM n GROUP BY job_id""")
def report_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """The JSON reports beside subtitle files, read again."""
    ws = kept(words(spark, d))
    shown = kept(display.starts(C.simple_cards(ws), C.onset(ws)))
    warned = shown.filter("card % 50 = 7").select("job_id", "card", F.lit("gap_not_applied").alias("code"), F.lit("x").alias("detail"), F.col("first_wid").alias("wid_start"), F.col("last_wid").alias("wid_end"))
    made = metrics.sidecars(shown, warned, F.concat(F.lit("job "), F.col("job_id").cast("string")), close_ms=60, timing=True)
    at = lambda path, kind: F.get_json_object("report", f"$.{path}").cast(kind)
    stats = [at(f"stats.{c}", k).alias(c) for c, k in (("cards", "long"), ("cards_over_cps", "long"), ("max_cps", "double"), ("mean_cps", "double"), ("closed_gaps", "long"), ("timing_clip", "boolean"))]
    return made.select("job_id", at("source", "string").alias("source"), *stats, at("warnings[0].code", "string").alias("first_code"))


@query(f"""WITH {WORDS}, b AS (SELECT job_id, wid, regexp_replace(w, '[^a-zA-Z]', 'q', 'g') AS a, 'r' || wid AS b FROM words WHERE wid % 7 = 0)
SELECT job_id, wid AS ord, CASE wid % 5 WHEN 0 THEN 'mapping' WHEN 1 THEN 'term' WHEN 2 THEN 'phrase' ELSE 'error' END AS kind, CASE WHEN wid % 5 IN (0, 4) THEN a END AS wrong, CASE wid % 5 WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN a || ' ' || b WHEN 3 THEN a || '=' || b ELSE b END AS "right" FROM b""")
def glossary_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every sort that a glossary file may hold."""
    ws = words(spark, d).filter("wid % 7 = 0").select("job_id", F.col("wid").alias("ord"), F.regexp_replace("w", "[^a-zA-Z]", "q").alias("a"), F.concat(F.lit("r"), "wid").alias("b"))
    how = F.col("ord") % 5
    line = F.when(how == 0, F.concat_ws(" => ", "a", "b")).when(how == 1, F.concat("a", F.lit(" # a term"))).when(how == 2, F.concat_ws(" ", "a", "b")).when(how == 3, F.concat_ws("=", "a", "b")).otherwise(F.concat_ws(" => ", "a", "b", F.lit("x")))
    found = files.glossary_lines(ws.select(F.struct("job_id", "ord").alias("ord"), line.alias("value")))
    return found.select("ord.job_id", "ord.ord", "kind", "wrong", "right")


@query(f"WITH {WORDS}, pc AS (SELECT DISTINCT lower(w) AS piece FROM words) SELECT DISTINCT trim({fold('piece')}) AS word FROM pc WHERE regexp_matches(piece, '^[a-z]+$') AND length(piece) > 1")
def vocabulary_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Whole words of a model's vocabulary."""
    return files.vocabulary_words(words(spark, d).select(F.lower("w").alias("piece")).distinct(), P)


@query(f"WITH {WORDS}, t AS (SELECT job_id, seg % 2 AS track, wid AS ord, w AS text FROM words) SELECT job_id, track, count(*) AS cards, string_agg(text, ' ' ORDER BY ord) AS text FROM t GROUP BY ALL")
def timeline_tracks(spark: SparkSession, d: str) -> DataFrame:
    return files.subtitle_tracks(words(spark, d).select("job_id", (F.col("seg") % 2).alias("track"), F.col("wid").alias("ord"), F.col("w").alias("text")))


@query(f"WITH {WORDS}, i AS (SELECT job_id, wid, 90000 + wid * 10 AS a, 90000 + wid * 10 + 7 AS b FROM words WHERE pos = 0) SELECT job_id, 1 AS track, CASE WHEN wid % 3 > 0 THEN 'clip' || wid END AS path, CAST(round((a - 90000) * 1000 / 25.0) AS BIGINT) AS timeline_start_ms, CAST(round((b - a) * 1000 / 25.0) AS BIGINT) AS duration_ms, CAST(round(wid * 1000 / 50.0) AS BIGINT) AS source_in_ms, wid % 3 > 0 AS resolved FROM i")
def timeline_cuts(spark: SparkSession, d: str) -> DataFrame:
    w, start = F.col("wid"), 90000 + F.col("wid") * 10
    items = words(spark, d).filter("pos = 0").select("job_id", F.lit(1).alias("track"), start.alias("start_frame"), (start + 7).alias("end_frame"), w.alias("source_frame"), F.lit(25.0).alias("fps"), F.lit(50.0).alias("source_fps"), F.lit(90000).alias("origin_frame"), F.when(w % 3 > 0, F.concat(F.lit("clip"), w)).alias("path"))
    return files.cut_list(items)


@query("SELECT CASE WHEN n IS NULL THEN 'Reel' ELSE 'Reel V' || (n + 1) END AS name FROM (SELECT max(CASE WHEN conv_id % 6 = 0 THEN 1 WHEN conv_id % 6 = 1 THEN conv_id END) AS n FROM conversations)")
def free_clip_name(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("conv_id")
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.when(i % 6 == 0, F.lit("REEL")).when(i % 6 == 1, F.concat(F.lit("reel v"), i)).otherwise(F.concat(F.lit("other v"), i)).alias("name"))
    return files.next_version(c, "Reel")


# --- metrics and history --------------------------------------------------------------------------------------------------


@query(f"WITH {CARDS}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY card) - end_ms AS gap FROM cards) SELECT job_id, count(*) FILTER (gap > 0 AND gap <= 60) AS closed_gaps FROM n GROUP BY job_id")
def gaps_to_close(spark: SparkSession, d: str) -> DataFrame:
    return metrics.closed_gaps(C.simple_cards(words(spark, d)), 60)


@query(f"WITH {CARDS} SELECT job_id, round(count(*) FILTER (cps > 25.0) / count(*), 4) AS pct_over_cps FROM cards GROUP BY job_id")
def share_over_speed(spark: SparkSession, d: str) -> DataFrame:
    return metrics.report(C.simple_cards(words(spark, d))).select("job_id", metrics.share_over_cps().alias("pct_over_cps"))


@query(f"WITH {COST}, {C._cards_sql()}, {warnings_sql('cards')}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY card, ord) AS place FROM warned), b AS (SELECT job_id, code, count(*) AS n, arg_min(detail, place) AS example, min(place) AS first FROM o GROUP BY ALL) SELECT job_id, code, n, example FROM b QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY first, code) <= 2")
def warning_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first two codes of a job, how often they occur and an example of each."""
    ws = words(spark, d)
    found = segmenter.card_warnings(C.simple_cards(ws), ws, P).withColumn("ord", F.struct("card", "ord"))
    return metrics.code_examples(found, 2).select("job_id", "code", "n", "example")


@query(f"WITH {CARDS}, st AS (SELECT job_id, count(*) AS cards, max(cps) AS max_cps FROM cards GROUP BY job_id) SELECT round(avg(cards), 6) AS mean_cards, round(avg(max_cps), 6) AS mean_max_cps FROM st WHERE job_id % 7 <> 3")
def history_means(spark: SparkSession, d: str) -> DataFrame:
    found = history.means(C.Q["bench_rows_null_not_zero"](spark, d), ["cards", "max_cps"])
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("SELECT DISTINCT conv_id AS job_id, 'f' || conv_id AS fingerprint FROM conversations WHERE conv_id % 4 IN (1, 2)")
def audio_to_prepare(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose cut list is not the one of the stored audio, or that have none."""
    now = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("job_id"), F.concat(F.lit("f"), "conv_id").alias("fingerprint")).distinct()
    stored = now.filter("job_id % 4 <> 1").withColumn("fingerprint", F.when(F.col("job_id") % 4 == 2, "old").otherwise(F.col("fingerprint")))
    return history.stale(now, stored)


@query("SELECT DISTINCT conv_id AS job_id, CASE WHEN conv_id % 4 IN (0, 3) AND conv_id % 3 > 0 THEN 'reused' ELSE 'rendered' END AS state FROM conversations")
def audio_states(spark: SparkSession, d: str) -> DataFrame:
    """Stored audio is used again where the cut list is the same and the file is there."""
    now = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("job_id"), F.concat(F.lit("f"), "conv_id").alias("fingerprint")).distinct()
    stored = now.filter("job_id % 4 <> 1").withColumn("fingerprint", F.when(F.col("job_id") % 4 == 2, "old").otherwise(F.col("fingerprint")))
    return history.prepared(now, stored, now.filter("job_id % 3 > 0"))


_SPEECH = "sp0 AS (SELECT job_id, start_ms AS s, end_ms AS e, max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM words)"


@query(f"WITH {WORDS}, {_SPEECH}, sp1 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 30 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM sp0) SELECT job_id, min(s) AS s, max(e) AS e FROM sp1 GROUP BY job_id, g")
def speech_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of speech: words with pauses of no more than 30 ms between them."""
    return spans.unite(words(spark, d).select("job_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), ["job_id"], slack=30)


# --- checks on broken input -----------------------------------------------------------------------------------------------


@query(f"WITH {CARDS} SELECT c.job_id, w.wid FROM words w JOIN cards c ON c.job_id = w.job_id AND w.wid BETWEEN first_wid AND last_wid WHERE card % 5 = 3 OR (card % 5 = 1 AND w.wid = last_wid)")
def cards_that_miss_words(spark: SparkSession, d: str) -> DataFrame:
    """Of cards some of which are gone or end a word early or twice, the words that are in none or in two."""
    ws = words(spark, d)
    cards = C.simple_cards(ws)
    i = F.col("card") % 5
    doubled = cards.filter(i == 1).withColumn("first_wid", F.col("last_wid"))
    return contract.cards_cover_words(cards.filter(i != 3).unionByName(doubled), ws)


@query(f"""WITH {CARDS} SELECT job_id, 'card ' || card AS path, unnest(CASE card % 6 WHEN 1 THEN ['not one or two lines', 'lines are not the text'] WHEN 2 THEN ['blank line', 'lines are not the text'] WHEN 3 THEN ['lines are not the text'] WHEN 4 THEN ['cps is off'] ELSE [] END) AS problem FROM cards""")
def cards_beyond_limits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("card") % 6
    text = F.col("text")
    lines = F.when(i == 1, F.array(text, text, text)).when(i == 2, F.array(text, F.lit(" "))).when(i == 3, F.array(F.concat(text, F.lit("!")))).otherwise(F.col("lines"))
    broken = C.simple_cards(words(spark, d)).withColumns({"lines": lines, "cps": F.when(i == 4, F.col("cps") + 1).otherwise(F.col("cps"))})
    return contract.card_checks(broken)


@query(f"WITH {WORDS} SELECT job_id, 'warning timing_clamped' AS path, 'range runs backwards' AS problem FROM words WHERE wid % 31 = 1 UNION ALL SELECT job_id, 'warning odd', 'unknown code' FROM words WHERE wid % 31 = 2 UNION ALL SELECT job_id, 'warning cps_exceeded', 'only one end of the range' FROM words WHERE wid % 31 = 3 UNION ALL SELECT job_id, 'word ' || wid, 'unknown reason' FROM words WHERE wid % 31 = 4")
def log_violations(spark: SparkSession, d: str) -> DataFrame:
    """Warnings and edits as no stage writes them."""
    i, wid = F.col("wid") % 31, F.col("wid")
    ws = words(spark, d)
    code = F.when(i == 1, "timing_clamped").when(i == 2, "odd").otherwise("cps_exceeded")
    warnings = ws.filter(i.between(1, 3)).select("job_id", code.alias("code"), wid.alias("wid_start"), F.when(i == 1, wid - 1).when(i == 2, wid).alias("wid_end"))
    return contract.log_checks(warnings, ws.filter(i.between(4, 5)).select("job_id", "wid", F.when(i == 4, "whim").otherwise("glossary").alias("reason")))


# --- the Hebrew profile ---------------------------------------------------------------------------------------------------

#: An invented text for each place in a job: attached letters, chains, numbers with units, Latin runs, marks split from their letters.
HEBREW_WORDS = ["של", "גינה", "את", "ענן,", "בבית", "ספר", "12", "שקל", "red", "fox", "עץ", "'יק", "אבל", "קולות", "וראש", "השנה.", "3", "ימים", "צ׳ק", "blue", "מים", "עם", "דלת", "חלון!", "בית", "חולים", "גשם", "תה"]
_AT = "(wid * wid + job_id * 5 + wid // 7) % " + str(len(HEBREW_WORDS))
H_WORDS = WORDS[: WORDS.rindex("words AS (")] + "latin AS (" + WORDS[WORDS.rindex("words AS (") + len("words AS (") :] + f",\nwords AS (SELECT * REPLACE ([{', '.join(map(_quote, HEBREW_WORDS))}][CAST({_AT} + 1 AS INT)] AS w) FROM latin)"


def hebrew(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr(_AT.replace("//", "div")) + 1
    return words(spark, d).withColumn("w", F.element_at(F.array(*map(F.lit, HEBREW_WORDS)), at.cast("int")))


def cost_sql(p: LanguageProfile, given: str) -> str:
    """Break costs of a profile's rules over the words that `given` defines."""
    some = lambda xs: ", ".join(map(_quote, xs))
    chains = some(f"{a} {b}" for a, b in p.chains)
    attached = f"length(a) >= 3 AND substring(a, 1, 1) IN ({some(p.prefixes)})"
    latin = "CASE WHEN regexp_matches(w, '[A-Za-z]') AND regexp_matches(nw, '[A-Za-z]') THEN 'english_phrase_split' END" if p.latin_rule else "NULL"
    weight = "CASE r " + " ".join(f"WHEN '{n}' THEN {x}" for n, x in RULE_WEIGHTS.items()) + " END"
    bonus = "CASE " + " ".join(f"WHEN gap_ms >= {least} THEN {b}" for least, b in GAP_BONUS) + " ELSE 0.0 END"
    return rf"""{C.SENT.replace(WORDS, given)}, n0 AS (SELECT *, lead(w) OVER (PARTITION BY job_id, sent ORDER BY wid) AS nw, lead(start_ms) OVER (PARTITION BY job_id, sent ORDER BY wid) - end_ms AS gap_ms FROM sents),
n1 AS (SELECT *, regexp_replace(w, '\p{{P}}', '', 'g') AS a, regexp_replace(nw, '\p{{P}}', '', 'g') AS b FROM n0),
n2 AS (SELECT *, CASE WHEN nw IS NULL OR regexp_matches(w, '[.?!…]\s*$') THEN [] ELSE list_filter([CASE WHEN a = {_quote(p.object_marker)} THEN 'et_split' WHEN a IN ({some(p.function_words)}) THEN 'function_word_line_end' END,
  CASE WHEN a || ' ' || b IN ({chains}) OR ({attached} AND substring(a, 2) || ' ' || b IN ({chains})) THEN 'construct_chain_split' END, CASE WHEN regexp_matches(a, '\p{{Nd}}') AND b IN ({some(p.units)}) THEN 'number_unit_split' END, {latin}], lambda x: x IS NOT NULL) END AS rules FROM n1),
cost AS (SELECT *, CASE WHEN nw IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(rules, lambda r: {weight})), 0)
  + CASE WHEN regexp_matches(w, '[.?!…]\s*$') THEN 1 WHEN regexp_matches(w, '[,;:]\s*$') THEN 2 WHEN b IN ({some(p.conjunctions)}) THEN 3 ELSE 4 END - {bonus} AS DOUBLE) END AS break_cost FROM n2)"""


H_COST = cost_sql(HEBREW, H_WORDS)


@query(f"WITH {H_COST} SELECT job_id, wid, coalesce(gap_ms, -1) AS gap_ms, break_cost, array_to_string(rules, ',') AS rules FROM cost")
def hebrew_break_cost(spark: SparkSession, d: str) -> DataFrame:
    costed = breaks.break_costs(rewrite.sentences(hebrew(spark, d)), HEBREW)
    return costed.select("job_id", "wid", F.coalesce("gap_ms", F.lit(-1).cast("long")).alias("gap_ms"), "break_cost", F.array_join("rules", ",").alias("rules"))


@query(f"WITH {H_COST} SELECT rule, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM cost) GROUP BY rule")
def hebrew_rules(spark: SparkSession, d: str) -> DataFrame:
    """All five rules occur."""
    costed = breaks.break_costs(rewrite.sentences(hebrew(spark, d)), HEBREW)
    return costed.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {SEGMENT.replace(COST, H_COST)} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY first_wid) - 1 AS card, first_wid, last_wid, start_ms, end_ms, text FROM best_cards")
def hebrew_cards(spark: SparkSession, d: str) -> DataFrame:
    return segmenter.cards(hebrew(spark, d), HEBREW).select("job_id", "card", "first_wid", "last_wid", "start_ms", "end_ms", "text")


@query(f"{NUMBERED.replace(COST, H_COST)}, {warnings_sql()} SELECT job_id, card, CAST(ord AS INT) AS ord, code, detail, wid_start, wid_end FROM warned")
def hebrew_warnings(spark: SparkSession, d: str) -> DataFrame:
    ws = kept(hebrew(spark, d))
    return segmenter.card_warnings(kept(segmenter.cards(ws, HEBREW)), ws, HEBREW)


def _h_fold(c: str, by: str = "") -> str:
    return f"translate(regexp_replace(strip_accents({c}), '\\p{{P}}', '{by}', 'g'), '{HEBREW.finals[0]}', '{HEBREW.finals[1]}')"


@query(f"WITH {H_WORDS} SELECT job_id, wid, {_h_fold('w')} AS matched, trim({_h_fold('w')}) AS folded, array_to_string(list_filter(string_split_regex({_h_fold('w', ' ')}, '\\s+'), lambda x: x <> ''), ' ') AS scored, regexp_replace(w, '[וי]', '', 'g') AS skeleton FROM words")
def hebrew_normalisers(spark: SparkSession, d: str) -> DataFrame:
    """The normalisers differ on purpose."""
    w = F.col("w")
    return hebrew(spark, d).select("job_id", "wid", T.for_match(w, HEBREW).alias("matched"), T.for_diff(w, HEBREW).alias("folded"), F.array_join(T.words_for_scoring(w, HEBREW), " ").alias("scored"), T.skeleton(w, HEBREW).alias("skeleton"))


@query(
    f"""WITH {H_WORDS}, c AS (SELECT *, CASE WHEN regexp_matches(w, '^[' || chr(39) || '׳’][א-ת]') AND regexp_matches(coalesce(lag(w) OVER (PARTITION BY job_id, seg ORDER BY pos), ''), '[גזצץ]$') THEN 1 ELSE 0 END AS c FROM words),
g AS (SELECT *, sum(1 - c) OVER (PARTITION BY job_id, seg ORDER BY pos) AS g FROM c)
SELECT job_id, seg, min(pos) AS pos, string_agg(w, '' ORDER BY pos) AS w, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, min(conf) AS conf FROM g GROUP BY job_id, seg, g"""
)
def hebrew_marked_letters(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.join_marked(hebrew(spark, d), HEBREW)


#: A mapping to a word that ends in a mark, one to itself, one that only an attached letter reaches, and one whose mark comes twice.
H_MAPPINGS = [("גינה", "גינה!"), ("גשם", "גשם"), ("חולים", "חולים"), ("דלת", "הדלת"), ("ענן", "ענן,")]
_H_V = f"CASE WHEN length(f) >= 3 AND substring(f, 1, 1) IN ({', '.join(map(_quote, HEBREW.prefixes))}) THEN [f, substring(f, 2)] ELSE [f] END"


@query(
    f"""WITH {H_WORDS}, m AS (SELECT {_h_fold('wrong')} AS norm, r AS "right" FROM (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in H_MAPPINGS)}) v(wrong, r)),
sp AS (SELECT *, {STEM.format('w', 1)} AS stem, {STEM.format('w', 2)} AS marks FROM words), st AS (SELECT DISTINCT stem, {_h_fold('stem')} AS f FROM sp WHERE stem <> ''),
ex AS (SELECT stem, arg_min("right", n) AS better FROM (SELECT stem, unnest({_H_V}) AS norm, unnest(range(0, len({_H_V}))) AS n FROM st) v JOIN m ON v.norm = m.norm GROUP BY stem)
SELECT job_id, wid, w AS before, better || marks AS after, 'glossary' AS reason FROM sp JOIN ex ON ex.stem = sp.stem WHERE better || marks <> w"""
)
def hebrew_mappings(spark: SparkSession, d: str) -> DataFrame:
    """A mapping whose right side ends in a mark gains the word's own mark behind it."""
    mappings = spark.createDataFrame(H_MAPPINGS, "wrong string, right string").select(T.for_match(F.col("wrong"), HEBREW).alias("norm"), "right")
    return glossary.apply(hebrew(spark, d), mappings, spark.createDataFrame([], "ord int, norm string, term string"), HEBREW)[1]
