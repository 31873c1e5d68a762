"""Language-model scores of whole documents: unigram base and a gated recurrent model with a class-factored softmax.

One aggregation over all training documents counts the words (by a 64-bit hash), the pairs of endings of neighbouring words and the pairs of
bytes within words. The counts give the base score, the frequent words, the distribution within the classes of rare words, and a
byte model that spells words which no training document has; the pairs of endings give the classes of rare words.

Scoring needs every token's count, and the vocabulary grows with the corpus, so it is not broadcast: documents are dealt to
blocks of about ``BLOCK_TOKENS`` tokens, each block asks for the counts of its own distinct words by a join, and with the answer
its texts are written as the model's inputs, two bytes a token. The classes of the frequent words come from what stands before them
in all training texts.

The recurrent model starts from a bounded sample (``SAMPLE_DOCS`` texts by a hash, ``SAMPLE_TOKENS`` at most) and then reads every
training document once: the documents are dealt to ``ROUNDS`` rounds, in a round each partition trains the model on its own
rows, and the partitions' parameters are averaged by their tokens. Each round's average is written to the checkpoint folder. A
chunk's documents are scored side by side, whole, from the longest, with the state carried across windows.

P(token | before) = P(class | state) * P(token | class). The ``FREQUENT`` most frequent words have classes with a softmax over their
words. Other words fall into classes by ending and count, and share the class by count; words without a count share a part of the
lowest class, N1 / (N1 + 2 N2) of it by the leave-one-out rule, in proportion to their probability under the byte model, so that no
word gets more than its spelling deserves. The end of a text is a class of its own.

A null or empty text is one end token; a null id counts as the text "" (not held out). Every row gives a row. A table without
training documents is scored with empty counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, gru

FOLDS, HELD_FOLD = 5, 1
FREQUENT, WORD_CLASSES, HIDDEN = 1024, 24, 24
SAMPLE_DOCS, SAMPLE_TOKENS = 500, 250_000
#: Rounds over the training documents, the step size of each, and the tokens of a partition in a round (more where the corpus is large).
ROUNDS, RATES, ROUND_TOKENS = 4, (0.004, 0.003, 0.002, 0.001), 600_000
#: Pieces of the parameters that are averaged apart.
PIECES = 16
BLOCK_TOKENS = 2_500_000
TEXT_CHUNK = 8 << 20
#: Rare words: bounds of their counts, codes of the last two bytes, and classes of such codes.
BINS, ENDINGS, SPELLINGS = (2, 8, 64), 128, 8
#: What stands before a frequent word, folded to so many codes.
BEFORE = 128
BYTES = 257
LN10 = float(np.log(10.0))
WORD, PAIR, SPELT = 0, 1, 2


def endings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A code of the last two bytes of each word. Words stand end to end in data, none is empty."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    last = at[1:] - 1
    two = data[last].astype(np.uint64) << np.uint64(8) | np.where(last > at[:-1], data[np.maximum(last - 1, 0)], 0).astype(np.uint64)
    return (common.mix64(two) % np.uint64(ENDINGS)).astype(np.int64)


def byte_pairs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its bytes and an end, each with the byte before: codes of the pairs end to end, and where each word begins."""
    n = len(at) - 1
    own = np.ones(len(data) + n, bool)
    first = at + np.arange(n + 1)
    own[first[1:] - 1] = False
    after = np.zeros(len(own), np.int64)
    after[own] = data.astype(np.int64) + 1
    before = np.r_[0, after[:-1]][: len(after)]
    return before * BYTES + after, first


def _looks(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of distinct words, their bytes and where each begins."""
    data, at = common.text_bytes(distinct)
    return common.byte_hashes(data, at).view(np.int64), endings(data, at), data, at


def bin_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BINS), count, side="right")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(kind, h, ending, c) over all training tokens but the ends: words by hash, pairs of endings of neighbours, pairs of bytes; rows: held, text."""

    def table(kind: int, h: np.ndarray, ending: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(ending.astype(np.int32)), pa.array(c.astype(np.int64))], names=["kind", "h", "ending", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, spelt = np.zeros(ENDINGS * ENDINGS, np.int64), np.zeros(BYTES * BYTES, np.int64)
        for t in common.chunks(batches, "text", TEXT_CHUNK):
            ws = common.words_of(t.column("text"), common.separators("space"), lower=True)
            if not ws.n:
                continue
            codes, distinct = ws.codes()
            h, ending, data, at = _looks(distinct)
            c = np.bincount(codes, minlength=len(h))
            yield table(WORD, h, ending, c)
            each = ending[codes]
            inside = np.ones(ws.n, bool)  # words with a word before them in their text
            inside[ws.first[:-1][ws.counts > 0]] = False
            pairs += np.bincount((np.r_[0, each[:-1]] * ENDINGS + each)[inside], minlength=len(pairs))
            code, first = byte_pairs(data, at)
            spelt += np.bincount(code, np.repeat(c, np.diff(first)), len(spelt)).astype(np.int64)
        for kind, n in ((PAIR, pairs), (SPELT, spelt)):
            some = np.flatnonzero(n)
            yield table(kind, some, np.zeros(len(some)), n[some])

    return rows.filter("not held").select("text").mapInArrow(run, "kind int, h long, ending int, c long").groupBy("kind", "h").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Fixed-size knowledge of the counts. frequent: sorted hashes, count: of each; spelling: class of each ending; share: logarithms of what a rare class shares out; spelt: log-probability of each pair of bytes."""

    n: int
    v: int
    ends: int
    frequent: np.ndarray
    count: np.ndarray
    spelling: np.ndarray
    mass: np.ndarray
    share: np.ndarray
    unseen: np.ndarray
    spelt: np.ndarray
    word_class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    word_column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    members: list[tuple[int, int]] = field(default_factory=list)

    @property
    def classes(self) -> int:
        return WORD_CLASSES + SPELLINGS * (len(BINS) + 1) + 1

    @property
    def inputs(self) -> int:
        return len(self.frequent) + self.classes

    @property
    def end(self) -> int:
        return self.inputs - 1

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and word column of each input: a rare word is read as its class."""
        return np.r_[self.word_class, np.arange(self.classes)].astype(np.int64), np.r_[self.word_column, np.full(self.classes, -1)].astype(np.int64)

    def read(self, h: np.ndarray, ending: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words: the input, and the log share within a rare class; for words without a count the share of all such words."""
        k = len(self.frequent)
        spell, bins = self.spelling[ending], bin_of(c)
        rare = spell * (len(BINS) + 1) + bins
        x = k + WORD_CLASSES + rare
        within = np.log(c + 0.5) - np.log(self.share[rare])
        low = bins == 0
        within[low] = np.where(c[low] > 0, np.log1p(-self.unseen[spell[low]]) - np.log(self.share[rare[low]]), np.log(self.unseen[spell[low]]))
        if k:
            at = np.minimum(np.searchsorted(self.frequent, h), k - 1)
            known = self.frequent[at] == h
            x, within = np.where(known, at, x), np.where(known, 0.0, within)
        return x, within

    def spelling_of(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log-probability of each word, byte by byte, under the byte model."""
        if len(at) < 2:
            return np.zeros(0)
        code, first = byte_pairs(data, at)
        return np.add.reduceat(self.spelt[code], first[:-1])


def _clusters(spread: np.ndarray, counts: np.ndarray, k: int, seed: int = 9) -> np.ndarray:
    """Rows of spread that point the same way; groups are kept of like size by taking rows in order of a split axis."""
    x = np.log1p(spread)
    x -= x.mean(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    groups = [np.arange(len(x))]
    while len(groups) < k:
        groups.sort(key=len)
        own = groups.pop()
        if len(own) < 2:
            groups.append(own)
            break
        y = x[own] - x[own].mean(axis=0)
        v = np.random.default_rng(seed).normal(size=y.shape[1])
        for _ in range(15):  # the main axis of the group
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        side = np.argsort(y @ v, kind="stable")
        groups += [own[side[: len(own) // 2]], own[side[len(own) // 2 :]]]
    out = np.zeros(len(x), np.int64)
    for g, own in enumerate(sorted(groups, key=lambda o: -counts[o].sum())):
        out[own] = g
    return out


def vocabulary(rows: DataFrame, counts: DataFrame) -> Vocabulary:
    """rows: held; counts: of corpus_counts. The driver sees FREQUENT words, and sums whose number the parameters bound."""
    words = counts.filter(F.col("kind") == WORD)
    top = words.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    top.sort(key=lambda r: r["h"])
    frequent, top_c = np.array([r["h"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    cut = sum((F.when(F.col("c") >= b, 1).otherwise(0) for b in BINS), F.lit(0))
    sums = words.groupBy("ending", cut.alias("bin")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()
    found = {WORD: np.zeros(0), PAIR: np.zeros(ENDINGS * ENDINGS), SPELT: np.zeros(BYTES * BYTES)}
    for r in counts.filter(F.col("kind") != WORD).select("kind", "h", "c").collect():
        found[r["kind"]][r["h"]] = r["c"]
    pairs = found[PAIR].reshape(ENDINGS, ENDINGS)
    spelling = _clusters(np.hstack([pairs, pairs.T]), pairs.sum(axis=0), SPELLINGS)
    spelt = found[SPELT].reshape(BYTES, BYTES) + 0.1
    spelt = np.log(spelt / spelt.sum(axis=1, keepdims=True)).ravel()

    ends = rows.filter("not held").count()
    n, v = sum(r["c"] for r in sums) + ends, sum(r["n"] for r in sums) + (ends > 0)
    bins = len(BINS) + 1
    mass, types = np.zeros(SPELLINGS * bins), np.zeros(SPELLINGS * bins)
    ones, twos = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in sums:
        s = spelling[r["ending"]]
        mass[s * bins + r["bin"]] += r["c"]
        types[s * bins + r["bin"]] += r["n"]
        ones[s] += r["n1"]
        twos[s] += r["n2"]
    for r in top:  # frequent words have classes of their own
        s = spelling[r["ending"]]
        i = s * bins + int(bin_of(np.array([r["c"]]))[0])
        mass[i] -= r["c"]
        types[i] -= 1
        ones[s] -= r["c"] == 1
        twos[s] -= r["c"] == 2
    share = mass + 0.5 * types
    low = np.arange(SPELLINGS) * bins
    share[low] = types[low]
    unseen = (ones + 0.5) / (ones + 2 * twos + 1.0)
    return Vocabulary(n, v, ends, frequent, top_c, spelling, np.maximum(mass, 0), np.maximum(share, 0.5), unseen, spelt)


def classify(tokens: DataFrame, vocab: Vocabulary) -> None:
    """Gives the frequent words classes, by what stands before them in all training texts of tokens (held, own)."""
    k = len(vocab.frequent)
    fold = (common.mix64(np.arange(vocab.inputs + 1)) % np.uint64(BEFORE)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * BEFORE, np.int64)
        for t in common.chunks(batches, "own", TEXT_CHUNK):
            x, first = _inputs(t.column("own"))
            before = np.r_[0, x[:-1]]
            before[first[:-1]] = vocab.inputs
            word = x < k
            total += np.bincount(x[word] * BEFORE + fold[before[word]], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    spread = np.zeros(k * BEFORE)
    if k:
        for r in tokens.filter("not held").select("own").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            spread[r["cell"]] = r["n"]
    vocab.word_class = _clusters(spread.reshape(k, BEFORE), vocab.count, WORD_CLASSES) if k else np.zeros(0, np.int64)
    by = np.argsort(vocab.word_class, kind="stable")
    vocab.word_column = np.empty(len(by), np.int64)
    vocab.word_column[by] = np.arange(len(by))
    sizes = np.bincount(vocab.word_class, minlength=WORD_CLASSES)
    vocab.members = [(int(b - s), int(b)) for b, s in zip(np.cumsum(sizes), sizes)]


def first_model(tokens: DataFrame, vocab: Vocabulary) -> gru.Model:
    """The model to start from, trained on the first texts by a hash, SAMPLE_DOCS and SAMPLE_TOKENS at most; a longer text is left to the rounds."""
    class_counts = np.concatenate([np.bincount(vocab.word_class, vocab.count, WORD_CLASSES), vocab.mass, [vocab.ends]])
    model = gru.Model.new(vocab.inputs, class_counts, vocab.count[np.argsort(vocab.word_class, kind="stable")], vocab.members, HIDDEN, 1)
    part = min(1.0, 3 * SAMPLE_DOCS / max(1, vocab.ends))
    place = F.xxhash64("doc_id", "own")
    some = tokens.filter("not held").filter(F.col("size") <= SAMPLE_TOKENS // 4).withColumn("place", place).filter(F.col("place") < F.lit(int((part - 0.5) * 2**63) * 2 if part < 1 else 2**63 - 1))
    some = some.orderBy("place", "own").limit(SAMPLE_DOCS)  # bounded: a few hundred rows, the tokens by the running sum
    kept = some.withColumn("sum", F.sum("size").over(W.orderBy("place", "own"))).filter(F.col("sum") <= SAMPLE_TOKENS).select("place", "own").collect()
    cls, col = vocab.outputs()
    docs = [(x, cls[x], col[x]) for x in (np.frombuffer(r["own"], np.uint16).astype(np.int64) for r in sorted(kept, key=lambda r: (r["place"], bytes(r["own"]))))]
    if docs:
        gru.train(model, docs)
    return model


def encoded(rows: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row for each row: doc_id, held, size, known, base, share (sums over the tokens), and the inputs x, and own as a text in training sees them, without itself in the counts."""
    width = common.shuffle_width(rows.sparkSession)
    blocks = max(width, -(-vocab.n * FOLDS // ((FOLDS - 1) * BLOCK_TOKENS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(width, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, pa.Array] = {}  # a few blocks' distinct words
        for t in common.chunks(batches, "text", TEXT_CHUNK):
            of = t.column("block").to_numpy()
            for b in np.unique(of):
                ws = common.words_of(t.column("text").filter(pa.array(of == b)), common.separators("space"), lower=True)
                h = pa.array(common.byte_hashes(*common.text_bytes(ws.distinct())).view(np.int64))
                wanted[int(b)] = pc.unique(pa.concat_arrays([wanted[int(b)], h]) if int(b) in wanted else h)
        for b, h in wanted.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b, np.int32)), h], names=["block", "h"])

    # All of dealt's columns go in, so that this and the cogroup below share one shuffle of the texts.
    wanted = dealt.mapInArrow(ask, "block int, h long")
    answers = wanted.join(counts.filter(F.col("kind") == WORD).select("h", "c").hint("merge"), "h").select("block", "h", "c")
    n, v, end = vocab.n, vocab.v, vocab.end

    def run(texts: pa.Table, answer: pa.Table) -> pa.Table:
        ah, ac = answer.column("h").to_numpy(), answer.column("c").to_numpy()
        by = np.argsort(ah)
        ah, ac = ah[by], ac[by]
        parts = []
        for t in common.chunks(iter(texts.to_batches()), "text", TEXT_CHUNK // 2):
            ws = common.words_of(t.column("text"), common.separators("space"), lower=True)
            codes, distinct = ws.codes()
            h, ending, data, starts = _looks(distinct)
            c = np.zeros(len(h), np.int64)
            if len(ah):
                at = np.minimum(np.searchsorted(ah, h), len(ah) - 1)
                c = np.where(ah[at] == h, ac[at], 0)
            x, within = vocab.read(h, ending, c)
            within = within + np.where(c > 0, 0.0, vocab.spelling_of(data, starts))
            own = vocab.read(h, ending, np.maximum(c - 1, 0))[0]
            # The end follows each text's words.
            first = ws.first + np.arange(t.num_rows + 1)
            place = np.ones(ws.n + t.num_rows, bool)
            place[first[1:] - 1] = False

            def spread(of: np.ndarray, last: float, kind) -> np.ndarray:
                out = np.full(len(place), last, kind)
                out[place] = of[codes] if len(of) else 0
                return out

            def inputs(of: np.ndarray) -> pa.Array:
                data = spread(of, end, np.uint16)
                return pa.Array.from_buffers(pa.binary(), t.num_rows, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(data)])

            base = spread(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), np.log10((vocab.ends + 0.5) / (n + 0.5 * (v + 1))), np.float64)
            known, base, share = (np.add.reduceat(s, first[:-1]) for s in (spread(c > 0, vocab.ends > 0, np.int64), base, spread(within, 0.0, np.float64)))
            parts.append(pa.table({"doc_id": t.column("doc_id"), "held": t.column("held"), "size": np.diff(first), "known": known, "base": base, "share": share, "x": inputs(x), "own": inputs(own)}))
        return pa.concat_tables(parts)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held boolean, size long, known long, base double, share double, x binary, own binary")


def _inputs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw, at = common.text_bytes(column)
    return raw.view(np.uint16).astype(np.int64), at // 2


def train_all(tokens: DataFrame, vocab: Vocabulary, model: gru.Model, folder: str) -> gru.Model:
    """The model after every training text of tokens (held, own) was read once, in rounds of averaged parameters."""
    spark = tokens.sparkSession
    parts = max(1, min(-(-vocab.n // (ROUNDS * ROUND_TOKENS)), 4 * common.shuffle_width(spark)))
    lanes = int(parts**0.5) + 1
    place = F.xxhash64("doc_id", "own")
    dealt = tokens.filter("not held").select(F.pmod(place, F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright(place, 8), F.lit(parts)).cast("int").alias("part"), "own")
    cls, col = vocab.outputs()
    names = sorted(model.p)
    for k in range(ROUNDS):

        def fit(batches: Iterator[pa.RecordBatch], start: gru.Model = model, rate: float = RATES[k]) -> Iterator[pa.RecordBatch]:
            own = gru.Model({name: w.copy() for name, w in start.p.items()}, start.members)
            adam, seen, texts = gru.Adam(own), 0, 0
            for t in common.chunks(batches, "own", 2 * ROUND_TOKENS):
                x, first = _inputs(t.column("own"))
                gru.read_once(own, adam, x, cls[x], col[x], first, rate)
                seen += len(x)
                texts += t.num_rows
            if seen:
                pieces = np.array_split(np.concatenate([own.p[name].ravel() for name in names]).astype(np.float64) * seen, PIECES)
                lane = seen % lanes
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([lane] * PIECES, pa.int32()), pa.array([seen] * PIECES, pa.int64()), pa.array([texts] * PIECES, pa.int64()), pa.array([w.astype(np.float64) for w in pieces], pa.list_(pa.float64()))], names=["piece", "lane", "n", "texts", "w"])

        def total(t: pa.Table) -> pa.Table:
            w = np.zeros(len(t["w"][0]))
            for one in t["w"]:
                w += one.values.to_numpy()
            return pa.table({"piece": t["piece"][:1], "lane": t["lane"][:1], "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "texts": pa.array([sum(t["texts"].to_pylist())], pa.int64()), "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

        kind = "piece int, lane int, n long, texts long, w array<double>"
        trained = common.deal(dealt.filter(F.col("round") == k).select("part", "own"), parts, "part").select("own").mapInArrow(fit, kind)
        # First by lanes, so that no task gets more than about the root of all partitions' parameters.
        trained.groupBy("piece", "lane").applyInArrow(total, kind).groupBy("piece").applyInArrow(total, kind).write.parquet(f"{folder}/round-{k}")
        got = spark.read.parquet(f"{folder}/round-{k}").orderBy("piece").select("n", "w").collect()  # PIECES rows
        if not got:
            continue
        flat = np.concatenate([np.array(r["w"]) / r["n"] for r in got]).astype(gru.F32)
        cuts = np.cumsum([model.p[name].size for name in names])[:-1]
        model = gru.Model({name: w.reshape(model.p[name].shape).copy() for name, w in zip(names, np.split(flat, cuts))}, model.members)
    return model


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = common.checkpointed(corpus_counts(rows))
    vocab = vocabulary(rows, counts)
    folder = common.new_folder(spark, "lm")
    encoded(rows, counts, vocab).write.parquet(f"{folder}/tokens")
    tokens = spark.read.parquet(f"{folder}/tokens")
    classify(tokens, vocab)
    model = train_all(tokens, vocab, first_model(tokens, vocab), folder)
    cls, col = vocab.outputs()
    n = vocab.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.chunks(batches, "x", TEXT_CHUNK // 2):
            x, first = _inputs(t.column("x"))
            ln = gru.score(model, x, cls[x], col[x], first)
            own = [t.column(c).combine_chunks() for c in ("doc_id", "held", "size", "known")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(t.num_rows, n)), t.column("base").combine_chunks(), pa.array((ln + t.column("share").to_numpy()) / LN10)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return tokens.select("doc_id", "held", "size", "known", "base", "share", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_score": query}
ORACLES: dict[str, str] = {}
