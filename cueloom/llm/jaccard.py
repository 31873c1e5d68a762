"""Near duplicates by the Jaccard similarity of word shingles: SimHash first, then whatever it cannot reach, so that every pair at or over the threshold is linked and no other.

A text is the set of 64-bit hashes of its five-word shingles (a shorter text is one shingle). Texts of equal sets form a class,
and only classes are searched. Links are found in turns, and a later turn looks only at classes that are not in one component yet:

1. SimHash: the classes' fingerprints (of the same shingles) are searched by the generalised pigeonhole, as in op9. Classes of near
   fingerprints are compared by their whole sets. This settles copies with few changes, which differ in few bits.
2. A pair of similarity 0.8 may differ in a dozen bits, out of the pigeonhole's reach. But under any one order of all shingles two such sets
   share l of the first n - ceil(0.8 n) + l shingles of each (prefix filter), so each class sends these, in the order of the hash, with
   l = 1 + n // ``SHARED``. Shingles that one class alone sends are dropped, and then classes that are left with too few.
3. Each class is compared with one other of each shingle, the one whose shingles are most common: in a big group of near copies that is
   the text from which the others were made. So a big group becomes one component at a linear cost.
4. What is left: classes that share a shingle of up to ``HOT`` members are paired if they share l of them. Those that share a more common one
   are dealt to pairs of bounded blocks, by the group that such shingles connect and by size, the group's main component
   only against the others; they are compared there, and a task sends on a spanning forest.

Every link is verified by whole sets. Empty and null texts are one class. A null doc_id is never a component's name. Repeated rows are
linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
OVER, UNDER = 4, 5
TEXT_CHUNK = 8 << 20
#: A set of n sends n // SHARED shingles more than it must, so that two similar sets share 1 + n // SHARED of those sent.
SHARED = 10
#: Members of a shingle up to which they are paired as rows.
HOT = 48
#: Shingles and classes of one block of a hot group.
BLOCK_SHINGLES, BLOCK_ROWS = 800_000, 3072
#: Classes for each part of the search's tables, which have no more parts than the session sets.
PART_CLASSES = 4000
#: Bits that tell which rows' sets are asked for, by the row's key; so many at every size, and where they fill up more sets are sent than asked for.
SIEVE = 1 << 25
#: Similar sets lie in one band of sizes or in neighbouring ones; a little wider than need be, for rounding.
BAND = 1.01 * UNDER / OVER


def sets_of(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, distinct and ascending, end to end, and where each text begins (one more than texts)."""
    ws = common.words_of(texts, common.separators("space"), lower=True)
    counts = ws.counts
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    if not ws.n:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    keys = common.word_keys(ws)
    first = common.ranges(ws.first[:-1], n)
    width = np.repeat(np.minimum(counts, shingle), n)
    h = np.zeros(len(first), np.uint64)
    for k in range(shingle):
        own = k < width
        h[own] = common.mix64(h[own] * np.uint64(0x9E3779B97F4A7C15) + keys[first[own] + k] + np.uint64(k + 1))
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def classes_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.r_[np.uint64(0), np.cumsum(common.mix64(h + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)]
    return common.mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def prefixes_of(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and shingle of each row to send."""
    n = np.diff(at)
    sent = np.where(n > 0, np.minimum(n, n - -(-OVER * n // UNDER) + 1 + n // SHARED), 0)
    return np.repeat(np.arange(len(n)), sent), h[common.ranges(at[:-1], sent)].view(np.int64)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").alias("text"))


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, cls, fp (the SimHash of the shingles) and the row's key, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.chunks(batches, text_col, TEXT_CHUNK):
            h, at = sets_of(t.column(text_col))
            fp = simhash.majority(h, np.diff(at))
            own = [t.column(c).combine_chunks() for c in (id_col, "k1", "k2")]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(classes_of(h, at)), pa.array(fp.view(np.int64)), *own[1:]], names=["doc_id", "cls", "fp", "k1", "k2"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *common.row_key(id_col, text_col))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, cls long, fp long, k1 long, k2 long")


def _each_class_once(h: np.ndarray, at: np.ndarray, cls: np.ndarray, seen: set[int]) -> np.ndarray:
    """Texts of classes that the task has not sent yet; a bounded memory, so that a class may come again."""
    if len(seen) > 500_000:
        seen.clear()
    own = []
    for i, c in enumerate(cls.tolist()):
        if c not in seen and at[i + 1] > at[i]:
            seen.add(c)
            own.append(i)
    return np.array(own, np.int64)


def entries(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, cls, n): the shingles that each class sends, and how many it has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for t in common.chunks(batches, "text", TEXT_CHUNK):
            h, at = sets_of(t.column("text"))
            cls = classes_of(h, at)
            own = _each_class_once(h, at, cls, seen)
            n = np.diff(at)[own]
            doc, key = prefixes_of(h[common.ranges(at[own], n)], np.r_[0, np.cumsum(n)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls[own][doc]), pa.array(n[doc].astype(np.int32))], names=["key", "cls", "n"])

    return _texts(docs, text_col).mapInArrow(run, "key long, cls long, n int")


def whole_sets(docs: DataFrame, id_col: str, text_col: str, sieve: np.ndarray) -> DataFrame:
    """(cls, shingles) of the rows whose key is in the sieve, and of some others; a class may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k1").to_numpy().view(np.uint64) & np.uint64(SIEVE - 1)
            hit = (sieve[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1)
            for t in common.chunks(iter([batch.filter(pa.array(hit > 0))]), "text", TEXT_CHUNK):
                h, at = sets_of(t.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(h, at)), lists], names=["cls", "shingles"])

    return docs.select(F.col(f"`{text_col}`").alias("text"), common.row_key(id_col, text_col)[0]).mapInArrow(run, "cls long, shingles array<long>")


def similar(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return (OVER + UNDER) * both >= OVER * (F.size(x) + F.size(y))


def _near(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar."""
    return UNDER * F.least(n, m) >= OVER * F.greatest(n, m)


class _Search:
    """Links and components so far. Each turn's pairs are written as a table, so that their number is known to the joins."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, parts: int):
        self.parts = parts  # of tables that are small beside the texts
        self.docs, self.id_col, self.text_col, self.classes, self.spark = docs, id_col, text_col, classes, docs.sparkSession
        self.folder, self.tables = common.new_folder(self.spark, "near"), 0
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def rooted(self, df: DataFrame) -> DataFrame:
        """df (cls, ...) with the root of each class; a class without links is its own."""
        return df.join(self.roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def table(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        df.coalesce(self.parts).write.parquet(f"{self.folder}/{self.tables}")
        return self.spark.read.parquet(f"{self.folder}/{self.tables}")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """The whole sets of the classes in wanted (cls). Only rows that a sieve of fixed size lets through are cut into shingles and sent."""
        k = F.col("k1").bitwiseAND(F.lit(SIEVE - 1))
        word, bit = F.shiftright(k, 6).alias("word"), F.expr("shiftleft(1L, cast(k1 & 63 as int))")
        rows = self.classes.join(wanted, "cls", "left_semi").groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # SIEVE / 64 rows at most
        sieve = np.zeros(SIEVE // 64, np.uint64)
        sieve[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return whole_sets(self.docs, self.id_col, self.text_col, sieve).join(wanted, "cls", "left_semi").dropDuplicates(["cls"])

    def settle(self, *found: DataFrame) -> None:
        for new in found:
            self.links = new if self.links is None else self.links.unionByName(new)
        self.roots = components(self.links)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar."""
        pairs = self.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        one, two = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "x"), ("b", "y")))
        return common.checkpointed(pairs.join(one, "a").join(two, "b").filter(similar(F.col("x"), F.col("y"))).select("a", "b").coalesce(self.parts))


def roots_of_similar(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that have a similar one; classes: cls, fp and k1, the key of one of its rows."""
    parts = max(1, min(common.shuffle_width(docs.sparkSession), -(-classes.count() // PART_CLASSES)))
    search = _Search(docs, id_col, text_col, classes, parts)
    search.settle(search.verified(_by_fingerprint(classes.select("cls", "fp"))))
    met = _met(docs, text_col, parts)
    search.settle(search.verified(_with_pivots(search.rooted(met))))
    left = common.checkpointed(_unsettled(search.rooted(met)).withColumn("members", F.count(F.lit(1)).over(W.partitionBy("key"))).coalesce(parts))
    hot = left.filter(F.col("members") > HOT)
    found = [search.verified(_pairs(left.filter(F.col("members") <= HOT)))] + ([] if hot.isEmpty() else [_in_blocks(search, hot)])
    search.settle(*found)
    common.drop_folder(search.spark, search.folder)  # links and roots are checkpointed
    return search.roots


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Candidate pairs: classes of one fingerprint with the smallest of them, and the smallest of linked fingerprints."""
    least = common.checkpointed(classes.groupBy("fp").agg(F.min("cls").alias("least")))
    linked = simhash.links(least.select("fp"), simhash.plan_probing(least))
    name = lambda c, as_: least.select(F.col("fp").alias(c), F.col("least").alias(as_))
    across = linked.join(name("a", "one"), "a").join(name("b", "two"), "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    salted = classes.withColumn("salt", F.pmod(F.hash("cls"), F.lit(simhash.SALTS)))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(simhash.SALTS - 1))))
    same = salted.join(every, ["fp", "salt"]).select(F.col("cls").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return across.unionByName(same)


def _met(docs: DataFrame, text_col: str, parts: int) -> DataFrame:
    """(key, cls, n, common) of the shingles sent by several classes, for classes with enough of them; common: how many classes send the shingles of this class, on average."""
    key = W.partitionBy("key")
    sent = entries(docs, text_col).repartition(parts, "key").dropDuplicates(["key", "cls"])
    met = common.checkpointed(sent.withColumn("members", F.count(F.lit(1)).over(key)).filter("members > 1"))
    # A similar class has at least 0.8 n shingles, and both send l of those that they share.
    least = F.lit(1) + F.floor(F.ceil(F.lit(OVER) * F.col("n") / UNDER) / SHARED)
    enough = met.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("own"), F.avg("members").alias("common")).filter(F.col("own") >= least).select("cls", "common")
    again = met.drop("members").join(enough.coalesce(parts), "cls").repartition(parts, "key").withColumn("members", F.count(F.lit(1)).over(key))
    return common.checkpointed(again.filter("members > 1").drop("members"))


def _unsettled(now: DataFrame) -> DataFrame:
    """Rows of the shingles whose members are in several components."""
    of = W.partitionBy("key")
    return now.withColumn("low", F.min("root").over(of)).withColumn("high", F.max("root").over(of)).filter("low <> high").drop("low", "high")


def _with_pivots(now: DataFrame) -> DataFrame:
    """Each class with the most common class of its shingles, of several the one that it shares most with."""
    chosen = F.max(F.struct("common", F.xxhash64("cls").alias("place"), "cls", "n", "root")).over(W.partitionBy("key"))
    found = _unsettled(now).withColumn("p", chosen).filter((F.col("root") != F.col("p.root")) & _near("n", "p.n"))
    shared = found.groupBy("cls", F.col("p.cls").alias("cls2"), "n", F.col("p.n").alias("n2")).agg(F.count(F.lit(1)).alias("shared"))
    best = shared.filter(_share_enough(4)).groupBy("cls").agg(F.max(F.struct("shared", "cls2")).alias("p"))
    return best.select(F.col("cls").alias("a"), F.col("p.cls2").alias("b"))


def _share_enough(times: int = 1) -> Column:
    """Whether a pair shares l of the shingles sent; times: one in so many of them is enough, as only shingles with the same pivot count."""
    return times * F.col("shared") >= F.lit(1) + F.floor(F.least("n", "n2") / SHARED)


def _pairs(left: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share enough shingles of few members."""
    one, two = left.select("key", "cls", "n", "root"), left.select("key", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "root")])
    met = one.join(two, "key").filter("cls < cls2 and root <> root2").filter(_near("n", "n2"))
    shared = met.groupBy("cls", "cls2", "n", "n2").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(_share_enough()).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))


def _in_blocks(search: _Search, left: DataFrame) -> DataFrame:
    """Links among classes that share a shingle of many members."""
    star = left.withColumn("low", F.min("cls").over(W.partitionBy("key"))).select(F.col("cls").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    group = components(star).select(F.col("node").alias("cls"), F.col("root").alias("grp"))
    own = search.table(group.join(left.groupBy("cls").agg(F.first("n").alias("n"), F.first("root").alias("root")), "cls"))
    main = own.groupBy("grp", "root").count().groupBy("grp").agg(F.max(F.struct("count", "root")).alias("m")).select("grp", F.col("m.root").alias("most"))
    band = F.floor(F.log("n") / float(np.log(BAND))).cast("int")
    own = own.join(main, "grp").select("grp", "cls", "root", "n", band.alias("band"), (F.col("root") == F.col("most")).alias("main"))
    where = ["grp", "main", "band"]
    blocks = own.groupBy(*where).agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    placed = own.join(blocks, where).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int")).select("cls", "root", *where, "block")
    every = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    first = every.filter("not main").select("grp", F.col("band").alias("band1"), F.col("block").alias("block1"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).withColumn("band", F.col("band1") + F.col("step"))
    cells = first.join(every, ["grp", "band"]).filter("main or step > 0 or (step = 0 and block1 <= block)").withColumn("cell", F.xxhash64("grp", "band1", "block1", *where[1:], "block"))
    left_of = placed.filter("not main").withColumnsRenamed({"band": "band1", "block": "block1"}).drop("main").join(cells.select("grp", "band1", "block1", "cell"), ["grp", "band1", "block1"])
    right_of = placed.join(cells.select(*where, "block", "cell"), [*where, "block"])
    rows = left_of.select("cls", "root", "cell", F.lit(False).alias("right")).unionByName(right_of.select("cls", "root", "cell", F.lit(True).alias("right")))
    rows = search.table(rows)
    full = rows.join(search.sets(rows.select("cls").distinct()), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.grouped_stream(batches, "cell"):
            a, b = compared(t["cls"].to_numpy(), t["root"].to_numpy(), t["right"].to_numpy(), t["shingles"].combine_chunks())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return common.checkpointed(full.repartition(search.parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long"))


def compared(cls: np.ndarray, root: np.ndarray, right: np.ndarray, sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell, rows on the left against rows on the right, as a forest. The counts of shared shingles are products of rows of noughts and ones, some columns at a time."""
    none = np.zeros(0, np.int64)
    offsets = sets.offsets.to_numpy()
    size = np.diff(offsets).astype(np.int64)
    values = sets.values.to_numpy()[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(cls)), size)
    sides = np.flatnonzero(~right), np.flatnonzero(right)
    found = [np.unique(values[right[row] == side]) for side in (False, True)]
    both_sides = np.intersect1d(*found, assume_unique=True)
    if not len(both_sides):
        return none, none
    code = np.minimum(np.searchsorted(both_sides, values), len(both_sides) - 1)
    hit = both_sides[code] == values
    code, row = code[hit], row[hit]
    by = np.argsort(code, kind="stable")
    code, row = code[by], row[by]
    place = np.zeros(len(cls), np.int64)
    for own in sides:
        place[own] = np.arange(len(own))
    shared = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    step = max(256, (1 << 22) // len(cls))
    for a in range(0, len(both_sides), step):
        lo, hi = np.searchsorted(code, [a, a + step])
        parts = []
        for side, own in zip((False, True), sides):
            m = np.zeros((len(own), step), np.float32)
            mine = np.flatnonzero(right[row[lo:hi]] == side) + lo
            m[place[row[mine]], code[mine] - a] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    x, y = sides
    i, j = np.nonzero(((OVER + UNDER) * shared >= OVER * (size[x][:, None] + size[y][None, :])) & (root[x][:, None] != root[y][None, :]))
    return simhash.forest(cls[x[i]], cls[y[j]])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id and component_id, the smallest id of its component."""
    of, named, names = _grouped(docs, id_col, text_col)
    # A big component's classes and a big class's rows are spread, as in op9.
    lookup = simhash.salted_lookup(named.select(F.col("cls").alias("fp"), "root"), names.select("root", F.col("least.doc_id").alias("component_id")))
    return simhash.salted_join(of.drop("fp").withColumnRenamed("cls", "fp"), lookup).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component: the one of the smallest id, null ids last; of repeated rows one."""
    _, _, names = _grouped(docs, id_col, text_col)
    return common.keep_rows(docs, names.select("least.k1", "least.k2"), id_col, text_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = common.checkpointed(classified(docs, id_col, text_col))
    classes = common.checkpointed(of.groupBy("cls").agg(F.min(simhash.least_row()).alias("least"), F.first("fp").alias("fp")))
    roots = roots_of_similar(docs, id_col, text_col, classes.select("cls", "fp", "least.k1"))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    return of, named, named.groupBy("root").agg(F.min("least").alias("least"))
