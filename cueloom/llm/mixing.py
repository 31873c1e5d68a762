"""Mixes sources to target weights, in blocks of a fixed number of words.

The words of a source, document after document in a pseudorandom order, are cut into blocks of ``block`` words. Output shards
have ``shard_slots`` slots each; a multinomial draw, seeded by the shard, gives how many slots of a shard each source fills. The
n-th slot of a source over all shards takes the block at place n of a pseudorandom permutation of the source's blocks (a new
permutation each time all have been used), so slots and blocks meet by an equijoin on the block's index.

Shards draw on their own and in parallel, so the totals of the draws miss the targets by chance. The surplus slots of some
sources, evenly spread, are then handed to the sources that are short, which makes each source's total exact to a block and
keeps every block, and so every document, at 2 uses at most.

Targets: sources by code point, null last, weigh 5, 2, 1 and so on in turn and share ``factor`` times all words; a target stops
at ``most`` times its source's words and the excess is shared anew by weight. A null or empty text has size 0 and is never
taken; a source without words has target 0. Repeated rows are separate documents. Nothing depends on partitioning: reruns agree.
The driver sees one row a source up to ``MAX_SOURCES`` of them. Of more, neighbours in that order are drawn together: shards draw counts of
groups, and a group's n-th use goes to the source that holds place n of a pseudorandom permutation of the group's slots; ranks,
targets and slots are then columns of a table, and the driver sees one row a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .quality import SPACE, SPLIT

WEIGHTS = (5, 2, 1)
FACTOR, MOST = 1.5, 2.0
BLOCK = 64
SHARD_SLOTS = 4096
SEED = 11
MAX_SOURCES = 100_000
#: Rows of one source that are dealt to so many tasks where sources are joined by shuffle.
SALTS = 32
#: Places of a source's slots that are listed at a time.
PLACES = 1 << 16


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess goes to the others by weight until none is above."""
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - math.fsum(fixed.values())
        weight = math.fsum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free}
        above = [i for i in free if share[i] > most * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in above}


@dataclass(frozen=True)
class Plan:
    """What is known of each source, by its index in the order of sources."""

    names: tuple
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    block: int
    shard_slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-int(self.slots.sum()) // self.shard_slots)

    def draw(self, shard: int) -> np.ndarray:
        left = int(self.slots.sum()) - shard * self.shard_slots
        p = self.slots / self.slots.sum()
        return np.random.default_rng([self.seed, shard]).multinomial(min(self.shard_slots, left), p)


def make_plan(names: list, sizes: list[int], block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, factor: float = FACTOR, most: float = MOST) -> Plan:
    size = np.array(sizes, np.int64)
    want = np.array(targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], factor * float(size.sum()), most)) if size.sum() else np.zeros(len(sizes))
    blocks = -(-size // block)
    mean = np.where(blocks > 0, size / np.maximum(blocks, 1), 1.0)
    slots = np.minimum(np.rint(want / mean), np.floor(most * blocks)).astype(np.int64)
    return Plan(tuple(names), size, want, blocks, slots, block, shard_slots, seed)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(n), one for each key, puts index: a Feistel network on the next power of four, walked until it falls below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        y, h, m, k = x[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        a, b = y >> h, y & m
        for r in range(4):
            a, b = b, a ^ (common.mix64(b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0x51ED2701)) & m)
        x[todo] = (a << h) | b
        todo[todo] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


def _running(df: DataFrame, by: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the same `by` that come before: first over whole buckets, then inside the bucket, so that no task gets all rows of one `by`."""
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = df.withColumns({"_inside": inside, "_rank": F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order))})
    # Sizes of what Python makes are not known to the planner; without the hint it may broadcast them.
    return ranked.join(before.hint("merge"), [*by, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    bare = F.btrim(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(SPACE))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPLIT))).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("place"),
    )


@dataclass(frozen=True)
class Mix:
    """sources: _name, src, source_size, target; filled: shard, src, use, block; most_docs: documents of the largest source; few: whether the sources may be broadcast."""

    sources: DataFrame
    filled: DataFrame
    most_docs: int
    few: bool


def mix_of(rows: DataFrame, most_sources: int | None = None, **kw) -> Mix | None:
    """None where there are no rows. rows: source and size."""
    spark, most_sources = rows.sparkSession, most_sources or MAX_SOURCES
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = stats.limit(most_sources + 1).collect()
    if not found:
        return None
    if len(found) > most_sources:
        return _many(common.checkpointed(stats), most_sources, **kw)
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan = make_plan([r["source"] for r in found], [r["size"] for r in found], **kw)
    known = spark.createDataFrame([(n, i, int(plan.sizes[i]), float(plan.targets[i])) for i, n in enumerate(plan.names)], "_name string, src long, source_size long, target double")
    return Mix(known, slots(spark, plan), max(r["n"] for r in found), True)


def _many(stats: DataFrame, most_sources: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, factor: float = FACTOR, most: float = MOST) -> Mix:
    """The same plan by columns; stats (source, size, n) is a stored table."""
    spark = stats.sparkSession
    ordered = common.checkpointed(stats.orderBy(F.col("source").isNull(), F.col("source")).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())  # one row a partition
    first = spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "part int, first long")
    rank = F.row_number().over(W.partitionBy("part").orderBy("at")) - 1
    numbered = ordered.join(F.broadcast(first), "part").withColumn("src", (F.col("first") + rank).cast("long"))  # one row a partition
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    table = common.checkpointed(numbered.select("source", "src", "size", "n", weight.cast("double").alias("weight"), (F.col("size") * most).alias("top")))
    n_sources, words, most_docs = table.agg(F.count(F.lit(1)), F.sum("size"), F.max("n")).first()
    level, fixed = 0.0, -1
    while True:  # more sources are full at each level, so it rises until none is added
        full = F.col("weight") * level > F.col("top")
        now, held, free = table.agg(F.count_if(full), F.sum(F.when(full, F.col("top")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if now == fixed or not free:
            break
        fixed, level = now, (factor * words - held) / free
    blocks = F.ceil(F.col("size") / block)
    target = F.least(F.col("weight") * level, F.col("top"))
    wanted = F.when(blocks > 0, F.least(F.rint(target * blocks / F.col("size")), F.floor(most * blocks))).otherwise(0).cast("long")
    group = F.expr(f"src div {-(-n_sources // most_sources)}")
    planned = table.select("source", "src", F.col("size").alias("source_size"), target.alias("target"), blocks.cast("long").alias("blocks"), wanted.alias("slots"), group.alias("grp"))
    before = F.coalesce(F.sum("slots").over(W.partitionBy("grp").orderBy("src").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    planned = common.checkpointed(planned.withColumn("before", before))
    totals = np.zeros(-(-n_sources // -(-n_sources // most_sources)), np.int64)
    for r in planned.groupBy("grp").agg(F.sum("slots").alias("slots")).collect():  # most_sources rows at most
        totals[r["grp"]] = r["slots"]
    drawn = slots(spark, Plan(tuple(range(len(totals))), totals, totals.astype(float), totals, totals, block, shard_slots, seed))
    some = planned.filter("slots > 0").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(PLACES).cast("long"))))
    places = some.withColumn("use", F.explode(F.sequence("from", F.least(F.col("from") + PLACES, F.col("slots")) - 1))).select("grp", (F.col("before") + F.col("use")).alias("place"), "src", "use", "blocks")
    met = drawn.select("shard", F.col("src").alias("grp"), F.col("block").alias("place")).join(places.hint("merge"), ["grp", "place"])

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"shard": f["shard"], "src": f["src"], "use": f["use"], "block": block_of(f["src"].to_numpy(), f["use"].to_numpy(), f["blocks"].to_numpy(), seed)})

    filled = met.select("shard", "src", "use", "blocks").mapInPandas(put, "shard long, src long, use long, block long")
    return Mix(planned.select(F.col("source").alias("_name"), "src", "source_size", "target"), filled, most_docs, False)


def block_of(src: np.ndarray, use: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """The block that the use-th slot of a source of n blocks takes."""
    return permuted(use % n, n, (src * 1_000_003 + use // n) * 2_654_435_761 + seed)


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """The mix: shard, src (index of the source), n-th use of the source, and the index of the block that fills the slot."""
    if not plan.shards:
        return spark.createDataFrame([], "shard long, src long, use long, block long")
    width = max(1, min(plan.shards, 4 * common.shuffle_width(spark)))

    def draws(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                n = plan.draw(int(shard))
                src = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.full(len(src), shard), "src": src.astype(np.int64), "n": n[src].astype(np.int64)})

    drawn = spark.range(0, plan.shards, 1, width).mapInPandas(draws, "shard long, src long, n long")
    got = np.zeros(len(plan.names), np.int64)
    for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect():
        got[r["src"]] = r["n"]
    surplus, short = np.maximum(got - plan.slots, 0), np.maximum(plan.slots - got, 0)
    surplus_at, short_to = np.cumsum(surplus) - surplus, np.cumsum(short)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            src = np.repeat(f["src"].to_numpy(np.int64), f["n"])
            j = common.ranges(f["first"].to_numpy(np.int64), f["n"].to_numpy(np.int64))
            over = j * surplus[src] // np.maximum(got[src], 1)
            moved = (j + 1) * surplus[src] // np.maximum(got[src], 1) > over
            use = j - over
            rank = (over + surplus_at[src])[moved]
            to = np.searchsorted(short_to, rank, side="right")
            use[moved] = got[to] + rank - (short_to - short)[to]
            src = src.copy()
            src[moved] = to
            yield pd.DataFrame({"shard": np.repeat(f["shard"].to_numpy(np.int64), f["n"]), "src": src, "use": use, "block": block_of(src, use, plan.blocks[src], plan.seed)})

    placed = _running(drawn.withColumn("part", F.expr("shard div 1024")), ["src"], "part", [F.col("shard")], "n", "first")
    return placed.select("shard", "src", "n", "first").mapInPandas(fill, "shard long, src long, use long, block long")


def pieces(rows: DataFrame, mix: Mix, block: int = BLOCK) -> DataFrame:
    """Where documents lie in the blocks of their source: src, block, from (word of the document) and words; a document without words has one empty piece."""
    same = F.col("source").cast("string").eqNullSafe(F.col("_name"))
    if mix.few:
        own = rows.join(F.broadcast(mix.sources), same)  # MAX_SOURCES rows at most
    else:
        salted = rows.withColumn("salt", F.pmod("place", F.lit(SALTS)))
        own = salted.join(mix.sources.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), same & (F.col("salt") == F.col("_salt"))).drop("salt", "_salt")
    buckets = max(64, -(-mix.most_docs // 20_000))
    placed = _running(own.drop("_name").withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets))), ["src"], "bucket", [F.col("place"), F.col("doc_id"), F.col("size")], "size", "first")
    b = F.lit(block)
    each = placed.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"greatest(first, first + size - 1) div {block}"))))
    begin = F.greatest(F.col("block") * b, F.col("first"))
    return each.withColumn("from", begin - F.col("first")).withColumn("words", F.greatest(F.lit(0), F.least((F.col("block") + 1) * b, F.col("first") + F.col("size")) - begin))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, **kw) -> DataFrame:
    """A row a document: doc_id, size, source_size, target and how many of its words the mix takes."""
    rows = common.checkpointed(sized(docs, id_col, text_col, source_col))
    mix = mix_of(rows, block=block, **kw)
    if mix is None:
        return rows.select("doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    uses = mix.filled.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
    met = pieces(rows, mix, block).join(uses.hint("merge"), ["src", "block"], "left")
    summed = met.groupBy("src", "bucket", "_rank", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    return summed.select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, **kw) -> DataFrame:
    """The mix itself: shard, src, use, block and the block's words joined by one space."""
    rows = common.checkpointed(sized(docs, id_col, text_col, source_col))
    mix = mix_of(rows, block=block, **kw)
    if mix is None:
        return docs.sparkSession.createDataFrame([], "shard long, src long, use long, block long, text string")
    bare = F.btrim(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(SPACE))
    # Equal ids and texts give equal words, so any row of that place will do.
    words = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("place"), F.split(bare, SPLIT).alias("_words")).dropDuplicates(["place"])
    part = pieces(rows, mix, block).filter("words > 0").join(words, "place").select("src", "block", "first", "from", F.slice("_words", (F.col("from") + 1).cast("int"), F.col("words").cast("int")).alias("w"))
    made = part.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("first", "from", "w"))).alias("p"))  # a block's pieces hold BLOCK words
    text = made.select("src", "block", F.array_join(F.flatten(F.transform("p", lambda x: x["w"])), " ").alias("text"))
    return mix.filled.join(text.hint("merge"), ["src", "block"]).select("shard", "src", "use", "block", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_mixing": query}
ORACLES: dict[str, str] = {}
