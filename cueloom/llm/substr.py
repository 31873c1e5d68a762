"""Substring deduplication with prefix-partitioned suffix trees.

A word is removed when a window of ``window`` words over it also starts in a document with a smaller id. Equal windows make a deep
node of the suffix tree of all texts, so the tree is built in parts that fit in memory:

1. The windows of all texts are counted by the hash of the prefix that they will be dealt by, in a fixed number of cells. From the
   counts every cell gets as many buckets as it needs for each to fit in memory, small cells share one.
2. Each task takes its documents in chunks. Where a chunk holds a window several times, the window's smallest document is the
   only one still open; the others are decided at once, and the window travels once, however common it is.
3. Open windows go to buckets by a prefix of varying length: the smallest hash of the word pairs in them; in a cell with several buckets, the
   smallest hash of their runs of four words; where those too are crowded, the hash of the whole window. Neighbouring windows
   mostly share such a prefix, so a bucket gets runs of words rather than one copy of the words for each suffix; this only chooses who
   builds which tree.
4. In a bucket, suffixes whose window hash occurs once cannot have a deep node and are left out. The others are split by prefixes
   of as many words as it takes to get groups of at most ``GROUP`` suffixes (small prefixes share a group). Each group becomes a
   subtree, from its sorted suffixes and their common prefix lengths: internal nodes at least ``window`` words deep are the
   repeats, and their leaves beyond the smallest document are marked.
5. Marks return to the documents by a join on a hash of id and text; equal windows inside a document share their marks.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A null or empty text has no words. Ids are of any type that can be ordered, and are compared in
its order; a null id counts as larger than any other, and no row as smaller than one of the same id, so repeated rows keep their
words. Within a chunk and within a bucket words have codes, which only equal words share; a hash of the word's bytes serves to choose its bucket
and no more. Windows that a chunk takes for equal are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Words of the prefixes that windows are dealt by, the shorter first.
SEED_WORDS = (2, 4)
#: A prefix of fewer bytes is taken only where a window has no longer one: short words are common.
SEED_BYTES = 9
#: Prefixes are counted in so many cells; a bucket is to get so many windows, and a task so many buckets.
CELLS, BUCKET_WINDOWS, TASK_BUCKETS, MOST_TASKS = 1 << 14, 800_000, 2, 200_000
#: A longer prefix is crowded where its cell has so many times the mean.
CROWDED = 4
GROUP = 1 << 16
TEXT_CHUNK = 5 << 20
NO_ID = np.iinfo(np.int64).max
BIG = np.uint64(1) << np.uint64(63)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(word_hash: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the window that starts at each word (meaningless where it would pass the end of its text)."""
    n = max(0, len(word_hash) - window + 1)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * MULTIPLIER + word_hash[j : j + n]
        h ^= h >> np.uint64(31)
    return h


def seeds(h: np.ndarray, lengths: np.ndarray, window: int, words: int) -> np.ndarray:
    """For each window start the smallest hash of its runs of so many words."""
    words = min(words, window)
    n = len(h) - words + 1
    t, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(words):
        t = common.mix64(t * MULTIPLIER + h[j : j + n])
        size += lengths[j : j + n]
    t = (t >> np.uint64(1)) | np.where(size < SEED_BYTES, BIG, np.uint64(0))
    width, have = window - words + 1, 1
    while have < width:
        step = min(have, width - have)
        t = np.minimum(t[: len(t) - step], t[step:])
        have += step
    return common.mix64(t)


@dataclass(frozen=True)
class Dealing:
    """Which bucket a window goes to: first and parts: the first bucket of each cell of the shorter prefix and how many it has; crowded: cells of the longer prefix."""

    first: np.ndarray
    parts: np.ndarray
    crowded: np.ndarray

    @property
    def buckets(self) -> int:
        return int((self.first + self.parts).max())

    @classmethod
    def of(cls, short: np.ndarray, long: np.ndarray, most: int) -> Dealing:
        """From the windows in each cell. Cells in a row share a bucket as long as it holds them; a cell of more has its own."""
        first, parts = np.zeros(len(short), np.int64), np.ones(len(short), np.int64)
        at, held = 0, 0
        for cell, n in enumerate(short.tolist()):
            if held and held + n > most:
                at, held = at + 1, 0
            first[cell] = at
            if n > most:
                parts[cell] = -(-n // most)
                at += int(parts[cell])
            else:
                held += n
        return cls(first, parts, long > CROWDED * max(1.0, long.mean()))

    def bucket(self, short: np.ndarray, long: np.ndarray, whole: np.ndarray) -> np.ndarray:
        cells = np.uint64(len(self.first))
        cell = (short % cells).astype(np.int64)
        inner = np.where(self.crowded[(long % cells).astype(np.int64)], common.mix64(whole + np.uint64(1)), common.mix64(long))
        return self.first[cell] + (inner % self.parts[cell].astype(np.uint64)).astype(np.int64)


def settled(halves: np.ndarray) -> np.ndarray:
    """A 64-bit key for each word (n x 2 halves of its hash) that only equal words share."""
    key, other = halves[:, 0].copy(), halves[:, 1]
    by = np.lexsort((other, key))
    clash = (key[by][1:] == key[by][:-1]) & (other[by][1:] != other[by][:-1])
    if clash.any():
        both = np.isin(key, key[by][1:][clash])
        key[both] = common.mix64(key[both] ^ common.mix64(other[both]))
    return key


def code_keys(codes: np.ndarray) -> np.ndarray:
    """A scrambled 64-bit key for each code that no other code has."""
    return common.mix64(np.asarray(codes, np.uint64) + np.uint64(1))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task."""
    return common.byte_hashes(*common.text_bytes(distinct))


def counted(docs: DataFrame, window: int, most: int, cells: int = CELLS) -> Dealing:
    """Step 1, over all windows of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(SEED_WORDS), cells), np.int64)
        for t in common.chunks(batches, "text", TEXT_CHUNK):
            ws = common.words_of(t.column("text"), common.separators("space")).without_places()
            if ws.n < window:
                continue
            codes, distinct = ws.codes()
            h, lengths = word_hashes(distinct)[codes], np.diff(ws.at)
            starts = common.ranges(ws.first[:-1], np.maximum(ws.counts - window + 1, 0))
            for k, words in enumerate(SEED_WORDS):
                n[k] += np.bincount((seeds(h, lengths, window, words)[starts] % np.uint64(cells)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n.ravel()[some])], names=["cell", "n"])

    total = np.zeros(len(SEED_WORDS) * cells, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 2 * cells rows
        total[r["cell"]] = r["n"]
    return Dealing.of(total[:cells], total[cells:], most)


def _runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of consecutive starts with equal values in same: index of each run's first start, and lengths."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = starts[1:] != starts[:-1] + 1
    for s in same:
        cut |= s[1:] != s[:-1]
    first = np.flatnonzero(np.r_[True, cut])
    return first, np.diff(np.r_[first, len(starts)])


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(raw)


def _unsqueezed(blobs: list[bytes]) -> np.ndarray:
    """Keys of the words of all chunks, which have one space after each; the texts themselves are not kept."""
    raw = b"".join([zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31) for blob in blobs])
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(raw)])
    return code_keys(words.dictionary_encode().indices.to_numpy(zero_copy_only=False))


def _pack(*columns: np.ndarray) -> bytes:
    """Equally long columns of whole numbers, as differences, compressed."""
    a = np.stack([np.diff(np.asarray(c, np.int64), prepend=np.int64(0)) for c in columns]) if columns else np.zeros((0, 0), np.int64)
    return _squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(a.shape[0], -1, 8).transpose(0, 2, 1)).tobytes())


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    a = np.ascontiguousarray(raw.reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64).reshape(columns, -1)
    return np.cumsum(a, axis=1)


_BUCKETED = pa.schema([("bucket", pa.int64()), ("segments", pa.binary()), ("words", pa.binary()), ("decided", pa.binary())])


def _equal_before(w: np.ndarray, at: np.ndarray, h: np.ndarray, window: int) -> np.ndarray:
    """Of sorted window hashes whose windows start at `at`: whether each window is equal to the one before, word by word."""
    same = np.r_[False, w[1:] == w[:-1]] if len(w) else np.zeros(0, bool)
    own = np.flatnonzero(same)
    for j in range(window):
        same[own] &= h[at[own] + j] == h[at[own - 1] + j]
    return same


def bucketed(docs: DataFrame, dealing: Dealing, window: int) -> DataFrame:
    """Steps 2 and 3 of docs (place, text, row_key): one row for each chunk and bucket. place: a whole number in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.chunks(batches, "text", TEXT_CHUNK):
            ids = t.column("place").combine_chunks()
            order = np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
            keys = t.column("row_key").to_numpy()
            ws = common.words_of(t.column("text"), common.separators("space")).without_places()
            if ws.n < window:
                continue
            codes, distinct = ws.codes()
            h = code_keys(codes)
            starts = common.ranges(ws.first[:-1], np.maximum(ws.counts - window + 1, 0))
            if not len(starts):
                continue
            row = np.repeat(np.arange(t.num_rows), np.maximum(ws.counts - window + 1, 0))
            w = window_hashes(h, window)[starts]
            by = np.lexsort((order[row], w))  # stable: equal ones stay by row
            sw, so, sr = w[by], order[row[by]], row[by]
            new = ~_equal_before(sw, starts[by], h, window)
            least = so[np.flatnonzero(new)[np.cumsum(new) - 1]]
            late = so > least
            again = ~new & ~late & np.r_[False, sr[1:] == sr[:-1]]  # the same window once more in a row
            decided = np.zeros(len(starts), bool)
            decided[by[late]] = True
            open_ = np.ones(len(starts), bool)
            open_[by[late | again]] = False
            o_start, o_row = starts[open_], row[open_]
            # By the words' hashes, as they were counted; other chunks must send an equal window to the same bucket.
            plain, lengths = word_hashes(distinct)[codes], np.diff(ws.at)
            whole = window_hashes(plain, window)[o_start]
            del by, sw, so, sr, new, least, late, again, w, h, codes
            bucket = dealing.bucket(*(seeds(plain, lengths, window, n)[o_start] for n in SEED_WORDS), whole)
            del whole, plain, lengths
            first, size = _runs(o_start, o_row, bucket)
            # The words with one space after each: a run of words is a slice of it.
            at = ws.at + np.arange(ws.n + 1)
            raw = common.spaced(ws.data, np.diff(ws.at)).tobytes()
            own = np.argsort(bucket[first], kind="stable")
            first, size = first[own], size[own]
            b, r, s = bucket[first], o_row[first], o_start[first]
            begin, end = at[s].tolist(), at[s + size + window - 1].tolist()
            d_first, d_size = _runs(starts[decided], row[decided])
            d_row, d_start = row[decided][d_first], starts[decided][d_first]
            gone = _pack(keys[d_row], d_start - ws.first[d_row], d_size) if len(d_row) else None
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, np.int64)
            out: dict[str, list] = {n: [] for n in _BUCKETED.names}
            bearer = int(keys[0]) % max(1, len(cuts) - 1)  # the bucket that takes the decided ones along, another for each chunk
            for k, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                out["bucket"].append(int(b[x]))
                out["segments"].append(_pack(keys[r[x:y]], order[r[x:y]], s[x:y] - ws.first[r[x:y]], size[x:y]))
                out["words"].append(_squeeze(b"".join([raw[p:q] for p, q in zip(begin[x:y], end[x:y])])))
                out["decided"].append(gone if k == bearer else None)
            if gone is not None and len(cuts) < 2:
                for n, v in zip(_BUCKETED.names, (int(keys[0]) % dealing.buckets, None, None, gone)):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_BUCKETED)

    return docs.select("place", "text", "row_key").mapInArrow(run, "bucket long, segments binary, words binary, decided binary")


# --- the trees of a bucket ------------------------------------------------------------------------------------------------


def prefix_groups(codes: np.ndarray, starts: np.ndarray, depth: int, most: int = GROUP) -> Iterator[tuple[np.ndarray, int]]:
    """Splits suffixes by prefixes of as many words as needed: (indexes of starts, length of the prefix that they share or 0)."""
    work = [(np.arange(len(starts)), 0)]
    while work:
        own, length = work.pop()
        if len(own) <= most or length >= depth:
            yield own, length
            continue
        nxt = codes[starts[own] + length]
        by = np.argsort(nxt, kind="stable")
        own = own[by]
        first = np.flatnonzero(np.r_[True, nxt[by][1:] != nxt[by][:-1]])
        sizes = np.diff(np.r_[first, len(own)])
        held, count = [], 0
        for a, n in zip(first.tolist(), sizes.tolist()):
            if n > most:
                work.append((own[a : a + n], length + 1))
                continue
            if count + n > most:
                yield np.concatenate(held), length
                held, count = [], 0
            held.append(own[a : a + n])
            count += n
        if held:
            yield np.concatenate(held), length


def subtree(codes: np.ndarray, starts: np.ndarray, shared: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the common prefix of each with the one before (0 for the first; counted up to depth words)."""
    columns = [codes[starts + j] for j in range(shared, depth)]
    order = np.lexsort(columns[::-1]) if columns else np.arange(len(starts))
    lcp = np.full(len(starts), depth, np.int64)
    for j in range(depth - 1, shared - 1, -1):
        c = columns[j - shared][order]
        lcp[1:][c[1:] != c[:-1]] = j
    lcp[:1] = 0
    return order, lcp


def repeats(codes: np.ndarray, starts: np.ndarray, owner: np.ndarray, depth: int, most: int = GROUP) -> np.ndarray:
    """Of each suffix, whether it hangs below a node at least depth words deep that also has a suffix of a smaller owner."""
    late = np.zeros(len(starts), bool)
    for own, shared in prefix_groups(codes, starts, depth, most):
        order, lcp = subtree(codes, starts[own], shared, depth)
        node = np.flatnonzero(lcp < depth)  # the leaves from one of these to the next hang below one deep node
        o = owner[own[order]]
        least = np.minimum.reduceat(o, node)
        late[own[order]] = o > np.repeat(least, np.diff(np.r_[node, len(o)]))
    return late


_MARKS = pa.schema([("row_key", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def _marks(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of marked window starts, one row a document."""
    if not len(key):
        return
    by = np.lexsort((start, key))
    key, start, size = key[by], start[by], size[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    offsets = pa.array(np.r_[first, len(key)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, size)]
    yield pa.RecordBatch.from_arrays([pa.array(key[first]), *lists], schema=_MARKS)


def marks(rows: DataFrame, buckets: int, window: int, group: int = GROUP) -> DataFrame:
    """Step 4: (row_key, at, n): n marked window starts from word at on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.grouped_stream(batches, "bucket"):
            for gone in t.column("decided").drop_null().to_pylist():
                yield from _marks(*_unpack(gone, 3))
            segs = [_unpack(x, 4) for x in t.column("segments").drop_null().to_pylist()]
            if not segs:
                continue
            key, owner, start, size = np.concatenate(segs, axis=1)
            h = _unsqueezed(t.column("words").drop_null().to_pylist())
            begin = np.cumsum(size + window - 1) - (size + window - 1)
            starts = common.ranges(begin, size)
            seg = np.repeat(np.arange(len(size), dtype=np.int32), size)
            w = window_hashes(h, window)[starts]
            by = np.argsort(w, kind="stable")
            same = w[by][1:] == w[by][:-1]
            kept = np.sort(by[np.r_[False, same] | np.r_[same, False]])
            if not len(kept):
                continue
            late = kept[repeats(h, starts[kept], owner[seg[kept]], window, group)]
            if not len(late):
                continue
            place = start[seg[late]] + starts[late] - begin[seg[late]]
            first, n = _runs(place, seg[late])
            yield from _marks(key[seg[late]][first], place[first], n)

    parts = max(common.shuffle_width(rows.sparkSession), min(MOST_TASKS, -(-buckets // TASK_BUCKETS)))
    return common.deal(rows, parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "row_key long, at array<int>, n array<int>")


def _kept_words(texts: pa.Array, at: list, n: list, window: int) -> tuple[common.Words, np.ndarray]:
    """Words of the texts and whether each stays."""
    ws = common.words_of(texts, common.separators("space")).without_places()
    gone = np.zeros(ws.n + 1, np.int32)
    marked = [i for i, x in enumerate(at) if x is not None and len(x)]
    if marked:
        sizes = ws.counts[marked]
        h = code_keys(ws.strings().take(pa.array(common.ranges(ws.first[marked], sizes))).dictionary_encode().indices.to_numpy(zero_copy_only=False))
        for i, z, size in zip(marked, np.cumsum(sizes).tolist(), sizes.tolist()):
            a = int(ws.first[i])
            w = window_hashes(h[z - size : z], window)
            hit = np.unique(w[common.ranges(np.asarray(at[i], np.int64), np.asarray(n[i], np.int64))])
            for s in (a + np.flatnonzero(np.isin(w, hit)),):
                np.add.at(gone, s, 1)
                np.add.at(gone, s + window, -1)
    return ws, np.cumsum(gone[:-1]) == 0


WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row_key, and place: the id itself where it is a whole number, otherwise a number in the order of the ids."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    if rows.schema["doc_id"].dataType.simpleString() in WHOLE:
        return rows.withColumn("place", F.col("doc_id").cast("long"))
    sorted_ = rows.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy("doc_id")
    places = common.checkpointed(sorted_.withColumn("place", F.monotonically_increasing_id()))
    return common.checkpointed(rows.join(places, "doc_id", "left"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = BUCKET_WINDOWS, group: int = GROUP) -> DataFrame:
    """A row for each row: doc_id, n_words, n_removed and kept, the words that stay joined by one space."""
    spark = docs.sparkSession
    rows = _placed(docs, id_col, text_col)
    dealing = counted(rows, window, most)
    found = marks(bucketed(rows, dealing, window), dealing.buckets, window, group)
    own = found.groupBy("row_key").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("n")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.chunks(batches, "text", TEXT_CHUNK):
            ws, stays = _kept_words(t.column("text"), t.column("at").to_pylist(), t.column("n").to_pylist(), window)
            lengths = np.diff(ws.at)
            kept_len = np.where(stays, lengths + 1, 0)
            ends = np.r_[0, np.cumsum(kept_len)][ws.first]
            raw = common.spaced(ws.data[np.repeat(stays, lengths)], lengths[stays]).tobytes()
            kept = [raw[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            removed = np.diff(np.r_[0, np.cumsum(~stays)][ws.first])
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(ws.counts), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    parts = common.TEXT_PARTS * common.shuffle_width(spark)
    met = rows.repartition(parts, "row_key").join(own.repartition(parts, "row_key").hint("merge"), "row_key", "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return met.select("doc_id", "text", "at", "n").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(deduplicate(common.table(spark, sf_dir, "documents")))


QUERIES = {"op8_substring_dedup": query}
#: Windows meet as joined words, which is exact, for words hold no spaces.
SQL = rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
late AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM s JOIN m ON s.k = m.k WHERE s.doc_id > m.least),
each AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT each.doc_id, count(late.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY each.p) FILTER (late.p IS NULL), '') AS t
         FROM each LEFT JOIN late ON late.doc_id = each.doc_id AND late.p = each.p GROUP BY each.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
ORACLES = {"op8_substring_dedup": SQL}
