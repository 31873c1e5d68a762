"""Benchmark decontamination with an FM-index per shard of training text.

The phrases are all windows of ``window`` consecutive words of a benchmark item (the whole item where it has fewer). Each task
takes its documents in shards of bounded size, writes words as numbers by the phrases' vocabulary, and builds an FM-index of the
shard; all phrases are searched backwards at once through wavelet-matrix ranks, their occurrences are located by sampled suffix
positions, and the words that they cover are merged into spans. Before the index is built, runs of words that are too short to
hold any phrase, or that hold a word of no phrase, are left out of the shard's text: nothing can occur there.

The benchmark is the stated query set. It is taken in blocks of ``BLOCK_WORDS`` words of whole items, each block a pass over the
documents, so what a pass sends to the tasks has a bound; with one block nothing is shuffled, with more the spans of a document
are merged by its key.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. A null or empty text has no words and no hits; items
without words have no phrases; a null item_id is left out of the items' list but its phrases count as hits. Every row gives a row, repeated rows too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fmindex import FMIndex

WINDOW = 13
#: Contaminated from one hit word in so many on.
RATIO = 20
BLOCK_WORDS = 2_000_000
TEXT_CHUNK = 16 << 20


@dataclass
class Phrases:
    """vocabulary: word -> number from 1 on; patterns: distinct phrases as rows of numbers; items: the items of each."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[tuple]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases_of(items: list[tuple], window: int = WINDOW) -> Phrases:
    """items: (item_id, text)."""
    ws = common.words_of(pa.array([t for _, t in items], pa.string()), common.separators("alnum"), lower=True)
    words = ws.strings().to_pylist()
    vocabulary: dict[bytes, int] = {}
    numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
    found: dict[tuple, set] = {}
    for i, (item, _) in enumerate(items):
        own = numbers[ws.first[i] : ws.first[i + 1]]
        for a in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[a : a + window]), set()).add(item)
    rows = sorted(found)
    patterns = np.zeros((len(rows), window), np.int64)
    for k, r in enumerate(rows):
        patterns[k, : len(r)] = r
    return Phrases(vocabulary, patterns, np.array([len(r) for r in rows], np.int64), [tuple(found[r]) for r in rows])


def occurrences(texts: pa.Array, p: Phrases) -> tuple[common.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, and of each occurrence its first word (counted over all texts), its length and its phrase."""
    ws = common.words_of(texts, common.separators("alnum"), lower=True)
    none = np.zeros(0, np.int64)
    if not ws.n or not len(p.lengths):
        return ws, none, none, none
    codes, distinct = ws.codes()
    number = np.fromiter((p.vocabulary.get(w, 0) for w in distinct.to_pylist()), np.int64, len(distinct))[codes]
    # Maximal runs of known words inside one text.
    starts = np.zeros(ws.n + 1, bool)
    starts[ws.first] = True
    known = number > 0
    new = known & (starts[:-1] | np.r_[True, ~known[:-1]])
    begin = np.flatnonzero(new)
    ends = np.flatnonzero(known & (starts[1:] | np.r_[~known[1:], True])) + 1
    long = ends - begin >= p.shortest
    begin, size = begin[long], (ends - begin)[long]
    if not len(begin):
        return ws, none, none, none
    # The shard's text: each run and a separator; at: where its words come from.
    at = common.ranges(begin, size + 1)
    last = np.cumsum(size + 1) - 1
    text = number[np.minimum(at, ws.n - 1)]
    text[last] = 0
    index = FMIndex(text, len(p.vocabulary) + 1)
    lo, hi = index.search(p.patterns, p.lengths)
    phrase = np.repeat(np.arange(len(lo)), hi - lo)
    place = at[index.locate(common.ranges(lo, hi - lo))]
    return ws, place, p.lengths[phrase], phrase


def covered(n: int, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, place, 1)
    np.add.at(delta, place + length, -1)
    return np.cumsum(delta[:-1]) > 0


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPAN = "array<struct<a:int,b:int>>"


def spans(docs: DataFrame, p: Phrases, id_col: str, text_col: str) -> DataFrame:
    """A row for each row: id, n_words, spans of hit words (from, to), their offsets in bytes, and the items that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.chunks(batches, text_col, TEXT_CHUNK):
            ws, place, length, phrase = occurrences(t.column(text_col).combine_chunks(), p)
            n_docs = t.num_rows
            hit = covered(ws.n, place, length)
            word_spans: list[list] = [[] for _ in range(n_docs)]
            byte_spans: list[list] = [[] for _ in range(n_docs)]
            items: list[set] = [set() for _ in range(n_docs)]
            _, text_at = common.text_bytes(t.column(text_col))
            for d in np.unique(np.searchsorted(ws.first, place, side="right") - 1):
                a, b = ws.first[d], ws.first[d + 1]
                for x, y in zip(*_runs(hit[a:b])):
                    word_spans[d].append({"a": int(x), "b": int(y)})
                    byte_spans[d].append({"a": int(ws.src[a + x] - text_at[d]), "b": int(ws.src_end[a + y - 1] - text_at[d])})
            doc = np.searchsorted(ws.first, place, side="right") - 1
            for d, k in set(zip(doc.tolist(), phrase.tolist())):
                items[d] |= set(p.items[k])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            listed = [sorted(str(i) for i in x if i is not None) for x in items]
            yield pa.RecordBatch.from_arrays([t.column(id_col).combine_chunks(), pa.array(ws.counts), pa.array(word_spans, kind), pa.array(byte_spans, kind), pa.array(listed, pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "byte_spans", "items"])

    return common.keep_columns(docs, [id_col, text_col]).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, spans {SPAN}, byte_spans {SPAN}, items array<string>")


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The query set in blocks of whole items, one after the other, one at least; an item longer than a block makes one of its own."""
    held, size, none = [], 0, True
    for r in benchmark.select(item_col, text_col).toLocalIterator():
        held.append((r[0], r[1] or ""))
        size += len(held[-1][1]) // 2
        if size >= block_words:
            yield phrases_of(held, window)
            held, size, none = [], 0, False
    if held or none:
        yield phrases_of(held, window)


_UNITE = """aggregate(sort_array(spans), cast(array() as {kind}), (acc, x) -> if(size(acc) > 0 and acc[size(acc) - 1].b >= x.a,
    concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].a as a, greatest(acc[size(acc) - 1].b, x.b) as b))), concat(acc, array(x))))"""


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each row: id, n_words, n_hit, items and the merged spans to remove, in words; contaminated by the ratio."""
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = spans(docs, first, id_col, text_col)
    else:
        key = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col)).withColumn("_key", F.struct(id_col, F.xxhash64(text_col).alias("h")))
        # Each block's pass is run before the next block is made, so the driver holds one block.
        each, todo = None, chain([first, second], blocks)
        del first, second
        for block in todo:
            done = common.checkpointed(spans(key.select("_key", text_col), block, "_key", text_col))
            each = done if each is None else each.unionByName(done)
        rows = key.groupBy("_key").count()
        joined = each.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        united = joined.withColumn("spans", F.expr(_UNITE.format(kind=SPAN)))
        # Equal ids and texts were grouped; each gets its row back.
        found = united.join(rows, "_key").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).select(F.col(f"_key.`{id_col}`").alias(id_col), "n_words", "spans", "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    counted = found.withColumn("n_hit", n_hit)
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs, all columns, without contaminated documents."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return find(packed, benchmark, "_row", "_text", **kw).filter(~F.col("contaminated")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op7_decontaminate": query}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows meet as joined words, which is exact, for words hold no spaces.
SQL = f"""WITH bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ph AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, (SELECT DISTINCT n FROM ph))),
hit AS (SELECT rid, win.n, i, win.k FROM win JOIN (SELECT DISTINCT n, k FROM ph) p ON p.n = win.n AND p.k = win.k),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, i + unnest(range(0, n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit JOIN ph ON ph.n = hit.n AND ph.k = hit.k WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce({RATIO} * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN cov ON cov.rid = dw.rid LEFT JOIN its ON its.rid = dw.rid"""
ORACLES = {"op7_decontaminate": SQL}
