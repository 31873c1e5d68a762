"""Readers and writers of transcripts, word lists, subtitles and timelines. All schemas are given; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import LanguageProfile

WARNING = "struct<stage:string,code:string,detail:string,wid_start:bigint,wid_end:bigint>"
WORD = "struct<wid:bigint,w:string,start:double,end:double,conf:double>"
META = f"struct<source_file:string,duration:double,language:string,engine:string,engine_version:string,created_at:string,stages:array<string>,warnings:array<{WARNING}>>"
EDIT = "struct<stage:string,wid:bigint,before:string,after:string,reason:string>"
SEGMENT = f"struct<id:bigint,start:double,end:double,text:string,words:array<{WORD}>,speaker:string,lines:array<string>,cps:double>"
TRANSCRIPT = f"struct<meta:{META},segments:array<{SEGMENT}>,edits:array<{EDIT}>>"
RAW = "struct<engine:string,version:string,language:string,duration:double,segments:array<struct<start:double,end:double,text:string,words:array<struct<w:string,start:double,end:double,conf:double>>>>>"


def _ms(seconds: str):
    return F.round(F.col(seconds) * 1000).cast("long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, raw): whole files; the job is the file's name without its ending."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("job_id"), F.col("value").alias("raw"))


def parse_transcripts(documents: DataFrame) -> DataFrame:
    """documents (job_id, raw)."""
    return documents.select("job_id", F.from_json("raw", TRANSCRIPT).alias("t")).select("job_id", "t.*")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(read_documents(spark, path))


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """The words table of transcript documents."""
    segs = transcripts.select("job_id", F.posexplode("segments").alias("seg", "s"))
    each = segs.select("job_id", "seg", F.posexplode("s.words").alias("pos", "x"))
    return each.select("job_id", "seg", "pos", F.col("x.wid").alias("wid"), F.col("x.w").alias("w"), _ms("x.start").alias("start_ms"), _ms("x.end").alias("end_ms"), F.col("x.conf").alias("conf"))


def read_raw_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_raw_words(read_documents(spark, path))


def parse_raw_words(documents: DataFrame) -> DataFrame:
    """Recogniser output before any wid, documents (job_id, raw): job_id, seg, pos, w, start_ms, end_ms, conf."""
    segs = documents.select("job_id", F.from_json("raw", RAW).alias("r")).select("job_id", F.posexplode("r.segments").alias("seg", "s"))
    each = segs.select("job_id", "seg", F.posexplode("s.words").alias("pos", "x"))
    return each.select("job_id", "seg", "pos", F.col("x.w").alias("w"), _ms("x.start").alias("start_ms"), _ms("x.end").alias("end_ms"), F.col("x.conf").alias("conf"))


def unknown_fields(spark: SparkSession, path: str) -> DataFrame:
    return unknown_keys(read_documents(spark, path))


def unknown_keys(documents: DataFrame) -> DataFrame:
    """documents (job_id, raw) -> (job_id, path, problem): top-level and meta keys missing or not foreseen; from_json would pass over them in silence."""
    docs = documents.select("job_id", F.from_json("raw", "map<string,string>").alias("top"))
    meta = docs.select("job_id", F.from_json(F.col("top")["meta"], "map<string,string>").alias("m"))

    def against(df: DataFrame, col: str, where: str, keys: list[str]) -> DataFrame:
        need = F.array(*map(F.lit, keys))
        have = F.coalesce(F.map_keys(col), F.array().cast("array<string>"))
        missing = df.select("job_id", F.explode(F.array_except(need, have)).alias("k")).select("job_id", F.lit(where).alias("path"), F.concat(F.lit("missing key "), "k").alias("problem"))
        more = df.select("job_id", F.explode(F.array_except(have, need)).alias("k")).select("job_id", F.lit(where).alias("path"), F.concat(F.lit("unexpected key "), "k").alias("problem"))
        return missing.unionByName(more)

    return against(docs, "top", "$", ["meta", "segments", "edits"]).unionByName(against(meta, "m", "$.meta", ["source_file", "duration", "language", "engine", "engine_version", "created_at", "stages", "warnings"]))


NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def type_checks(documents: DataFrame) -> DataFrame:
    """documents (job_id, raw) -> (job_id, path, problem): values of words that are not of their kind, which a reader with a schema would make null in silence. A truth value is no number."""
    segs = documents.select("job_id", F.posexplode(F.from_json("raw", "segments array<struct<words:array<variant>>>")["segments"]).alias("seg", "s"))
    # The kind of a word object reads OBJECT<conf: DECIMAL(2,2), w: STRING, ...>.
    looked = F.transform("s.words", lambda x: F.struct(F.schema_of_variant(x).alias("told"), *[F.try_variant_get(x, f"$.{n}", "double").alias(n) for n in ("start", "end")]))
    each = segs.select("job_id", "seg", F.posexplode(looked).alias("pos", "x")).select("job_id", "seg", "pos", "x.*")
    kind = lambda name: F.regexp_extract("told", rf"[<\s]{name}: (\w+(\([0-9,]+\))?)", 1)
    fine = lambda name: F.round(name, 3) == F.col(name)
    checks = [
        (kind("wid") != "BIGINT", "wid is not a whole number"),
        (kind("w") != "STRING", "w is not a text"),
        (~kind("conf").rlike(NUMBER) & ~kind("conf").isin("VOID", ""), "conf is neither a number nor null"),
        *((~kind(n).rlike(NUMBER), f"{n} is not a number") for n in ("start", "end")),
        *((kind(n).rlike(NUMBER) & ~fine(n), f"{n} has more than three decimals") for n in ("start", "end")),
        *((kind(n).rlike(NUMBER) & (F.col(n) < 0), f"{n} is negative") for n in ("start", "end")),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(problem)) for bad, problem in checks]))
    path = F.concat(F.lit("$.segments["), F.col("seg").cast("string"), F.lit("].words["), F.col("pos").cast("string"), F.lit("]"))
    return each.select("job_id", path.alias("path"), F.explode(found).alias("problem"))


def write_stage(df: DataFrame, path: str, stage: str) -> None:
    df.write.mode("overwrite").json(f"{path}/{stage}")


# --- word lists -----------------------------------------------------------------------------------------------------------


def glossary_lines(lines: DataFrame) -> DataFrame:
    """lines (ord, value) -> ord, kind (mapping, term, phrase, error), wrong, right."""
    v = F.trim(F.regexp_replace("value", "#.*$", ""))
    arrow = F.split(v, "=>")
    wrong, right = F.trim(arrow[0]), F.trim(arrow[1])
    one = lambda c: (F.size(T.tokens(c)) == 1)
    kind = (
        F.when(v.contains("=>"), F.when((F.size(arrow) == 2) & one(wrong) & one(right), "mapping").otherwise("error"))
        .when(v.contains("="), "error")
        .when(one(v), "term")
        .otherwise("phrase")
    )
    return lines.withColumn("v", v).filter("v <> ''").select("ord", kind.alias("kind"), F.when(v.contains("=>"), wrong).alias("wrong"), F.when(v.contains("=>"), right).otherwise(v).alias("right"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of one list file, in order: the whole file is one row first, for order is its meaning."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))


def read_glossary(spark: SparkSession, path: str, p: LanguageProfile) -> tuple[DataFrame, DataFrame]:
    """mappings (norm, right) and terms (ord, norm, term); a line that is neither is an error when it is read."""
    found = glossary_lines(read_lines(spark, path))
    checked = found.withColumn("right", F.when(F.col("kind") == "error", F.raise_error(F.concat(F.lit("bad glossary line "), F.col("ord").cast("string")))).otherwise(F.col("right")))
    mappings = checked.filter("kind in ('mapping', 'error')").select("ord", T.for_match(F.col("wrong"), p).alias("norm"), "right")
    mappings = mappings.groupBy("norm").agg(F.max_by("right", "ord").alias("right"))
    terms = found.filter("kind = 'term'").select("ord", T.for_match(F.col("right"), p).alias("norm"), F.col("right").alias("term"))
    return mappings, terms


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_terms(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """(ord, term): right sides and terms, each at its first place; no terms where the file is missing and may be."""
    if missing_ok and not _there(spark, path):
        return spark.createDataFrame([], "ord int, term string")
    return glossary_lines(read_lines(spark, path)).filter("kind <> 'error'").groupBy(F.col("right").alias("term")).agg(F.min("ord").alias("ord")).select("ord", "term")


def read_lexicon(spark: SparkSession, path: str, p: LanguageProfile) -> DataFrame:
    """(word): the letter runs of a user's word list; none where it is missing."""
    from ..operators.glossary import learn_words

    if not _there(spark, path):
        return spark.createDataFrame([], "word string")
    return learn_words(spark.read.text(path).select(F.col("value").alias("text")), p)


def vocabulary_words(pieces: DataFrame, p: LanguageProfile) -> DataFrame:
    """pieces (piece) of a model's vocabulary -> (word): those that are whole words of the language, folded."""
    return pieces.filter(F.col("piece").rlike(f"^[{p.letters}]+$") & (F.length("piece") > 1)).select(T.for_diff(F.col("piece"), p).alias("word")).distinct()


# --- subtitles ------------------------------------------------------------------------------------------------------------

HEADER = r"(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})"


def srt_starts(subtitles: DataFrame) -> DataFrame:
    """(job_id, ord, start_ms) of subtitle files (job_id, raw)."""
    each = subtitles.select("job_id", F.posexplode(F.regexp_extract_all("raw", F.lit(HEADER), 0)).alias("ord", "h"))
    part = lambda i: F.regexp_extract("h", HEADER, i).cast("long")
    return each.select("job_id", "ord", (part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)).alias("start_ms"))


def srt_cards(subtitles: DataFrame) -> DataFrame:
    """(job_id, ord, text): the text between headers without its index line, tags and spare white space."""
    body = F.split(F.regexp_replace("raw", "^﻿", ""), rf"(?m)^\s*\d+\s*\r?\n\s*{HEADER}[^\n]*\n?")
    each = subtitles.select("job_id", F.posexplode(F.slice(body, 2, 1_000_000)).alias("ord", "t"))
    return each.select("job_id", "ord", F.trim(F.regexp_replace(F.regexp_replace("t", "<[^>]*>|\\{[^}]*\\}", ""), T.SPACES, " ")).alias("text")).filter("text <> ''")


def references(texts: DataFrame, subtitles: DataFrame) -> DataFrame:
    """(job_id, text, has_cuts): a text file wins for the text, subtitles give the cuts."""
    of_srt = srt_cards(subtitles).groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("srt_text"))
    joined = texts.select("job_id", F.col("raw").alias("own")).join(of_srt, "job_id", "full_outer")
    return joined.select("job_id", F.coalesce("own", "srt_text").alias("text"), F.col("srt_text").isNotNull().alias("has_cuts"))


def split_media(media: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media with a reference, and without."""
    return media.join(refs, "job_id", "left_semi"), media.join(refs, "job_id", "left_anti")


def write_subtitles(rendered: DataFrame, path: str) -> None:
    """rendered (job_id, text): one file a job, under job_id=..."""
    body = F.expr("if(endswith(text, '\n'), substring(text, 1, length(text) - 1), text)")  # the writer ends the row with a line feed
    rendered.select("job_id", body.alias("value")).repartition("job_id").write.mode("overwrite").partitionBy("job_id").text(path)


def write_reports(sidecars: DataFrame, path: str) -> None:
    """sidecars (job_id, report): one file a job, beside the subtitles of the same name."""
    sidecars.select("job_id", F.col("report").alias("value")).repartition("job_id").write.mode("overwrite").partitionBy("job_id").text(path)


# --- timelines ------------------------------------------------------------------------------------------------------------


def subtitle_tracks(items: DataFrame) -> DataFrame:
    """items (job_id, track, ord, text) -> cards and text of each track."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return items.groupBy("job_id", "track").agg(F.count(F.lit(1)).alias("cards"), F.trim(F.regexp_replace(text, T.SPACES, " ")).alias("text"))


def cut_list(items: DataFrame) -> DataFrame:
    """items (job_id, track, start_frame, end_frame, source_frame, fps, source_fps, origin_frame, path) -> times in ms; resolved tells whether the media is known."""
    ms = lambda f, fps: F.round(F.col(f) * 1000 / F.col(fps)).cast("long")
    return items.select(
        "job_id", "track", "path",
        F.round((F.col("start_frame") - F.col("origin_frame")) * 1000 / F.col("fps")).cast("long").alias("timeline_start_ms"),
        F.round((F.col("end_frame") - F.col("start_frame")) * 1000 / F.col("fps")).cast("long").alias("duration_ms"),
        ms("source_frame", "source_fps").alias("source_in_ms"), F.col("path").isNotNull().alias("resolved"),
    )


def next_version(names: DataFrame, base: str) -> DataFrame:
    """names (name) -> the next free name: base, or base V2 and on."""
    n = F.when(F.lower("name") == base.lower(), 1).otherwise(F.regexp_extract(F.lower("name"), rf"^\Q{base.lower()}\E v(\d+)$", 1).try_cast("int"))
    return names.agg(F.max(n).alias("n")).select(F.when(F.col("n").isNull(), F.lit(base)).otherwise(F.concat(F.lit(f"{base} V"), (F.col("n") + 1).cast("string"))).alias("name"))


def existing_audio(spark: SparkSession, path: str, not_ending: tuple[str, ...] = ()) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    for s in not_ending:
        files = files.filter(~F.col("path").endswith(s))
    return files.orderBy("path")


