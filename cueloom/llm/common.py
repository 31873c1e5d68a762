"""Pieces that several training-data operators share: byte-level tokenising, streaming over sorted groups, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot interfere."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key(id_col: str, text_col: str) -> list[Column]:
    """k1 and k2: 128 bits of id and text. Rows that share them are repeated rows; null ids and ids on several texts are told apart."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit(1), t, i).alias("k2")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, whose row_key is in kept (k1, k2); of repeated rows one. Repeated rows are thinned before the shuffle."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(id_col, text_col))
    rank = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.xxhash64("_row")))
    return keyed.withColumn("_rank", rank).filter("_rank = 1").join(kept, ["k1", "k2"], "left_semi").select("_row.*")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where none is set, a temporary one if all runs in one process on this machine; on a cluster that is an error, for executors would each write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cueloom-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no DataFrame in use reads, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def separators(pattern: str) -> np.ndarray:
    """256 flags of the bytes that end a word: "space" is [\\x20\\x09-\\x0D]; "alnum" keeps 0-9, A-Z, a-z and bytes of 0x80 up."""
    sep = np.zeros(256, bool)
    if pattern == "space":
        sep[[9, 10, 11, 12, 13, 32]] = True
    else:
        sep[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            sep[a:b] = False
    return sep


def lower_map() -> np.ndarray:
    m = np.arange(256, dtype=np.uint8)
    m[65:91] += 32
    return m


@dataclass
class Words:
    """Words of a batch of texts. data: their bytes end to end; at: where each begins in data (one more than words); first: the first word of each text (one more than texts); src: where each word begins in the texts' bytes."""

    data: np.ndarray
    at: np.ndarray
    first: np.ndarray
    src: np.ndarray
    src_end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def without_places(self) -> Words:
        """Without src and src_end, where memory counts."""
        none = np.zeros(0, np.int64)
        return Words(self.data, self.at, self.first, none, none)

    def strings(self) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.data)])

    def distinct(self) -> pa.Array:
        """The distinct words, as of codes."""
        return pc.unique(self.strings()) if self.n else pa.array([], pa.large_binary())

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the distinct words by code."""
        if not self.n:
            return np.zeros(0, np.int32), pa.array([], pa.large_binary())
        d = self.strings().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end and where each begins; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    at = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, sep: np.ndarray, lower: bool = False) -> Words:
    """Splits whole texts into words in a few passes over their bytes."""
    raw, at = text_bytes(texts)
    n = len(raw)
    own = raw.tobytes()  # tables of bytes are looked up without an index of eight bytes for each
    if lower:
        own = own.translate(lower_map().tobytes())
    raw, word = np.frombuffer(own, np.uint8), np.frombuffer(own.translate((~sep).tobytes()), bool)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word
    here = np.zeros(n + 1, bool)
    here[:n] = word
    begin = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    starts = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=starts[1:])
    return Words(raw[word], starts, np.searchsorted(begin, at).astype(np.int64), begin, end)


def spaced(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words that stand end to end in data, with one space after each."""
    out = np.full(len(data) + len(lengths), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[np.cumsum(lengths + 1) - 1] = False
    out[own] = data
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... for lengths[i] each, end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    out[heads] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def grouped_stream(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal key, one table each, from batches sorted by key; a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Tables of about most_bytes of text each; a single longer text makes one of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        i = batch.schema.get_field_index(column)
        lengths = batch.column(i).cast(pa.large_binary())
        cum = np.cumsum(pc.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        a = 0
        base = 0
        while a < batch.num_rows:
            room = most_bytes - size
            b = int(np.searchsorted(cum, base + max(room, 1), side="left")) + 1
            b = min(max(b, a + 1), batch.num_rows)
            held.append(batch.slice(a, b - a))
            size += int(cum[b - 1] - base)
            base = cum[b - 1]
            a = b
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_keys(ws: Words) -> np.ndarray:
    """A 64-bit hash of each word; distinct words are hashed once."""
    codes, distinct = ws.codes()
    return keys_of(*text_bytes(distinct))[codes] if ws.n else np.zeros(0, np.uint64)


def keys_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """XXH64 of each word; at: where each begins in data, and the end."""
    raw, edges = data.tobytes(), at.tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])), np.uint64, len(edges) - 1)


#: A random number for each byte at each place in a word; longer words are hashed one by one.
_PLACES = 64
_BYTE_HASHES = np.random.default_rng(8).integers(0, 1 << 64, 256 * _PLACES, np.uint64)


def byte_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task, of all words at once; at: where each begins in data, and the end. None is empty."""
    if len(at) < 2:
        return np.zeros(0, np.uint64)
    lengths = np.diff(at)
    cell = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)  # in place, for memory's sake
    cell -= np.repeat(at[:-1].astype(cell.dtype), lengths)
    np.minimum(cell, _PLACES - 1, out=cell)
    cell *= 256
    cell += data
    h = mix64(np.add.reduceat(_BYTE_HASHES[cell], at[:-1]))
    for i in np.flatnonzero(lengths > _PLACES).tolist():
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i + 1]].tobytes())
    return h


def wide_keys(ws: Words) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of each word, and of each code the two halves of its XXH3-128 (n x 2) and the word."""
    codes, distinct = ws.codes()
    data, at = text_bytes(distinct)
    raw, edges = data.tobytes(), at.tolist()
    digest = xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]), np.uint64).reshape(-1, 2)
    return codes, halves, distinct


def deal(df: DataFrame, parts: int, by: str) -> DataFrame:
    """Rows of number `by` to partition by % parts: even where there are few numbers to a partition, which hashing is not."""
    return df.repartitionById(parts, F.pmod(F.col(by), F.lit(parts)).cast("int"))


#: Shuffles that carry whole texts get so many partitions for each one that the session sets, so that what a task fetches at once is small.
TEXT_PARTS = 4
