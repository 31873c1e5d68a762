"""Near duplicates by SimHash, with candidates from the generalised pigeonhole principle.

Fingerprints: bit k of 64 is 1 if it is set in over half of the XXH64 hashes of the text's word shingles. Documents of equal
fingerprint form a class; only distinct fingerprints are searched, and only those rows move.

Search: the bits are grouped so that correlated bits share a partition. If partition i is given threshold t_i and the t_i add up
to distance - partitions + 1, any two fingerprints within the distance agree within t_i on some partition i. The thresholds (-1:
not probed) come from dynamic programming on estimated candidate counts, taken from value counts of each partition over all
fingerprints; the number of partitions is chosen by the same estimate. One row a fingerprint and partition goes to its own value
(index) and to all values within t_i (probes); equal keys meet, and pairs are verified by their differing bits.

Skew: a key with many fingerprints (a big group of near copies) is dealt out as pairs of blocks of bounded size, so no task holds
an unbounded group, and each task sends on a spanning forest of what it verified in place of all pairs, which keeps the
components exact. Components are found by star contractions on tables; nothing of the corpus goes to the driver but the counts
of a bounded number of partition values.

A null, empty or blank text has fingerprint zero and is linked like any other. A null doc_id is never a component's name: its
row gets its component's smallest id, null if there is none. Repeated rows are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, DISTANCE, SEED, BITS = 4, 4, 42, 64
#: Members of a key that one task compares with each other at most.
BLOCK = 2048
TEXT_CHUNK = 8 << 20


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    ws = common.words_of(texts, common.separators("space"), lower=True)
    if not ws.n:
        return np.zeros(len(ws.counts), np.uint64)
    # The words of all texts with one space after each: a shingle is a slice of it.
    lengths = np.diff(ws.at)
    at = ws.at[:-1] + np.arange(ws.n)
    raw = common.spaced(ws.data, lengths).tobytes()
    counts = ws.counts
    shingles = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = common.ranges(ws.first[:-1], shingles)
    width = np.repeat(np.minimum(counts, shingle), shingles)
    last = first + width - 1
    end = at[last] + lengths[last]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), end.tolist())), np.uint64, len(first))
    return majority(h, shingles)


def majority(h: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """For each text the bits set in over half of its hashes; h: the hashes end to end, sizes: how many each text has (none: zero)."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    heads = (np.cumsum(sizes) - sizes)[some]
    ones = np.zeros((len(some), BITS), np.int64)
    for lo in range(0, len(h), at_once):  # a bounded number of hashes at a time, however long a text is
        bits = np.unpackbits(np.ascontiguousarray(h[lo : lo + at_once]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(heads, lo, side="right") - 1, np.searchsorted(heads, lo + len(bits))
        ones[a:b] += np.add.reduceat(bits, np.maximum(heads[a:b] - lo, 0), axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and the row's key, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.chunks(batches, text_col, TEXT_CHUNK):
            fp = fingerprints_of(t.column(text_col), shingle)
            own = [t.column(c).combine_chunks() for c in (id_col, "k1", "k2")]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(fp.view(np.int64)), *own[1:]], names=["doc_id", "fp", "k1", "k2"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *common.row_key(id_col, text_col))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long, k1 long, k2 long")


# --- the plan -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Probing:
    """parts: the bit positions of each partition; thresholds: how many of its bits may differ, -1 where it is not probed."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def values(self, fp: np.ndarray, i: int) -> np.ndarray:
        v = np.zeros(len(fp), np.int64)
        for k, bit in enumerate(self.parts[i]):
            v |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
        return v

    def flips(self, i: int) -> np.ndarray:
        width, t = len(self.parts[i]), self.thresholds[i]
        return np.array([sum(1 << b for b in c) for n in range(t + 1) for c in combinations(range(width), n)], np.int64)


def group_bits(correlation: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Partitions of equal width, each grown from a bit by the bits most correlated with it."""
    left, out = set(range(len(correlation))), []
    for p in range(parts):
        width = len(left) // (parts - p)
        c = np.abs(correlation)
        start = max(left, key=lambda b: (sum(c[b, o] for o in left if o != b), -b))
        own = [start]
        left.remove(start)
        while len(own) < width:
            best = max(left, key=lambda b: (sum(c[b, o] for o in own), -b))
            own.append(best)
            left.remove(best)
        out.append(tuple(sorted(own)))
    return tuple(out)


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Dynamic programming: a threshold for each partition, adding up to total, of least summed cost."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for options in cost:
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for done, (c, ts) in best.items():
            for t, more in options.items():
                key = done + t
                if key not in nxt or c + more < nxt[key][0]:
                    nxt[key] = (c + more, (*ts, t))
        best = nxt
    return best[total]


#: What sending one probe costs, in compared pairs.
PROBE_COST = 30.0
#: Bits of a partition whose values are counted; wider partitions are taken to split their counts evenly over the other bits.
COUNTED_BITS = 16


def plan_probing(distinct: DataFrame, distance: int = DISTANCE) -> Probing:
    """Correlations and value counts over all fingerprints, aggregated to at most parts * 2^COUNTED_BITS rows; then the cheapest plan."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float64) * 2 - 1
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "g"])

    # One row a task; summed by aggregation before the driver sees 64 * 64 numbers.
    sums = distinct.select("fp").mapInArrow(gram, "n long, g array<double>").select("n", F.posexplode("g").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    g = np.zeros(BITS * BITS)
    n = 0
    for r in sums:
        g[r["k"]], n = r["x"], r["n"]
    if n < 2:
        return Probing(group_bits(np.zeros((BITS, BITS)), 4), (1, 0, 0, 0))
    options: list[tuple[float, Probing]] = []
    layouts = [group_bits(g.reshape(BITS, BITS) / n, m) for m in range(3, distance + 2)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for m, parts in enumerate(layouts):
                for i in range(len(parts)):
                    v, c = np.unique(Probing(parts, ()).values(fp, i) & ((1 << COUNTED_BITS) - 1), return_counts=True)
                    k = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, m, np.int32)), pa.array(np.full(k, i, np.int32)), pa.array(v), pa.array(c.astype(np.int64))], names=["m", "i", "v", "c"])

    # Only the moments are needed: pairs of equal values, and of values one bit apart.
    table = distinct.select("fp").mapInArrow(counted, "m int, i int, v long, c long").groupBy("m", "i", "v").agg(F.sum("c").alias("c"))
    flips = F.expr(f"transform(sequence(-1, {COUNTED_BITS - 1}), b -> if(b < 0, v, v ^ shiftleft(1L, b)))")
    near = table.select("m", "i", "c", F.posexplode(flips).alias("k", "v"))
    other = table.select("m", "i", "v", F.col("c").alias("d"))
    moment = near.join(other, ["m", "i", "v"]).groupBy("m", "i").agg(F.sum(F.when(F.col("k") == 0, F.col("c").cast("double") * F.col("d"))).alias("same"), F.sum(F.col("c").cast("double") * F.col("d")).alias("one"))
    found = {(r["m"], r["i"]): (r["same"], r["one"]) for r in moment.collect()}
    for m, parts in enumerate(layouts):
        cost = []
        for i, part in enumerate(parts):
            same, one = found[(m, i)]
            extra = max(0, len(part) - COUNTED_BITS)
            pairs = {0: same / 2**extra, 1: one / 2**extra + extra * same / 2**extra}
            pairs[2] = pairs[1] * len(part) / 2
            size = {0: 1, 1: 1 + len(part), 2: 1 + len(part) + len(part) * (len(part) - 1) // 2}
            cost.append({-1: 0.0} | {t: pairs[t] + PROBE_COST * n * size[t] for t in pairs})
        try:
            total, ts = allocate(cost, distance - len(parts) + 1)
        except KeyError:
            continue
        options.append((total, Probing(parts, ts)))
    return min(options, key=lambda o: o[0])[1]


# --- search ---------------------------------------------------------------------------------------------------------------


def signatures(distinct: DataFrame, plan: Probing) -> DataFrame:
    """fp -> rows (key, probe, fp): its own value in each probed partition (probe false), and all values within the threshold (probe true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i, t in enumerate(plan.thresholds):
                if t < 0:
                    continue
                own = plan.values(fp, i)
                key = np.int64(i) << np.int64(58)
                yield _rows(key | own, np.zeros(len(fp), bool), fp)
                for f in plan.flips(i)[1:]:
                    yield _rows(key | (own ^ f), np.ones(len(fp), bool), fp)

    def _rows(key: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(probe), pa.array(fp.view(np.int64))], names=["key", "probe", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, probe boolean, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as a-b: each node to the smallest of its component."""
    if not len(a):
        return a, b
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lo = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], lo)
        np.minimum.at(new, label[y], lo)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _compare(keys: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key, index rows before probe rows: each row against the index rows of its key; links as a forest."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    index = np.add.reduceat((~probe).astype(np.int64), first)
    start, have = first[group], index[group]
    me = np.arange(len(keys))
    # An index row meets the index rows before it; a probe row meets all index rows of the key.
    have = np.where(probe, have, me - start)
    order = np.argsort(-have, kind="stable")
    sorted_have = have[order]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held, k = 0, 0
    while True:
        n = int(np.searchsorted(-sorted_have, -k))
        if not n:
            break
        rows = order[:n]
        x, y = fp[rows], fp[start[rows] + k]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        if near.any():
            links.append((x[near], y[near]))
            held += int(near.sum())
            if held > 1_000_000:
                links = [forest(np.concatenate([p for p, _ in links]), np.concatenate([q for _, q in links]))]
                held = len(links[0][0])
        k += 1
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate([p for p, _ in links]), np.concatenate([q for _, q in links]))


def links(distinct: DataFrame, plan: Probing, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints within the distance, enough of them that the components are those of all such pairs."""
    sig = signatures(distinct, plan)
    # Keys with more index rows or probes than a block are dealt to pairs of blocks.
    sizes = sig.groupBy("key").agg(F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("i"), F.count(F.lit(1)).alias("n"))
    hot = sizes.filter((F.col("i") > 0) & (F.col("n") > block)).select("key", F.ceil(F.col("i") / block).cast("int").alias("bi"), F.ceil(F.col("n") / block).cast("int").alias("bp"))
    spread = F.xxhash64("fp", F.lit(7))
    dealt = (
        sig.join(_all_salts(hot), [sig["key"] == F.col("hot_key"), F.pmod(F.hash("fp"), F.lit(SALTS)) == F.col("salt")], "left")
        .withColumn("x", F.pmod(spread, F.coalesce("bi", F.lit(1))))
        .withColumn("y", F.pmod(spread, F.coalesce("bp", F.lit(1))))
    )
    # In a hot key every row probes (as its y-block) each x-block of index rows.
    as_index = dealt.filter(~F.col("probe")).select("key", F.lit(False).alias("probe"), "fp", "x", F.explode(F.sequence(F.lit(0), F.coalesce("bp", F.lit(1)) - 1)).alias("y"))
    as_probe = dealt.filter(F.col("probe") | F.col("bi").isNotNull()).select("key", F.lit(True).alias("probe"), "fp", F.explode(F.sequence(F.lit(0), F.coalesce("bi", F.lit(1)) - 1)).alias("x"), F.col("y"))
    cells = as_index.unionByName(as_probe).select(F.xxhash64("key", "x", "y").alias("cell"), "probe", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            a, b = _compare(t["cell"].to_numpy(), t["probe"].to_numpy(), t["fp"].to_numpy().view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for t in _whole_groups(batches):
            held.append(t)
            rows += t.num_rows
            if rows >= 200_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    width = common.shuffle_width(distinct.sparkSession)
    return cells.repartition(width, "cell").sortWithinPartitions("cell", "probe").mapInArrow(run, "a long, b long")


SALTS = 32


def _all_salts(hot: DataFrame) -> DataFrame:
    return hot.select(F.col("key").alias("hot_key"), "bi", "bp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut so that no cell is in two of them; many cells each."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        cells = t["cell"].to_numpy()
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None:
        yield rest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """A row a document: doc_id, fp and component_id."""
    fps, named, names = _grouped(docs, id_col, text_col, shingle, distance, block)
    return salted_join(fps, salted_lookup(named, names.select("root", F.col("least.doc_id").alias("component_id"))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one document of each component: the one of the smallest id, null ids last; of repeated rows one."""
    _, _, names = _grouped(docs, id_col, text_col, shingle, distance, block)
    return common.keep_rows(docs, names.select("least.k1", "least.k2"), id_col, text_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    fps = common.checkpointed(fingerprinted(docs, id_col, text_col, shingle))
    classes = common.checkpointed(fps.groupBy("fp").agg(F.min(least_row()).alias("least")))
    plan = plan_probing(classes, distance)
    roots = components(links(classes, plan, distance, block))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return fps, named.select("fp", "root"), named.groupBy("root").agg(F.min("least").alias("least"))


def least_row() -> Column:
    """What the smallest of a group is taken of: the row of the smallest id, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")


def salted_lookup(named: DataFrame, names: DataFrame) -> DataFrame:
    """fp -> component_id; a big component's fingerprints are spread over salts."""
    salted = named.withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALTS)))
    return salted.join(names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["root", "salt"]).select("fp", "component_id")


def salted_join(fps: DataFrame, of: DataFrame) -> DataFrame:
    """Documents of one fingerprint may be a third of all: they too are spread."""
    salted = fps.withColumn("salt", F.pmod(F.hash("k1"), F.lit(SALTS)))
    return salted.join(of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["fp", "salt"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": query}
ORACLES: dict[str, str] = {}
