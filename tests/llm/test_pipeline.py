"""The pipeline against plain Python, stage by stage, and the shared byte-level helpers."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cueloom.llm import common, jaccard, lines, mixing, quality, simhash
from tests.llm.test_llm import ALNUM_WORDS, SPACE_WORDS, ascii_lower, plain_fingerprint, plain_quality, roots

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> list[tuple]:
    r = random.Random(12)
    vocab = [f"word{i}" for i in range(900)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = []
    for i in range(40):
        body = [line(r.randint(20, 40)) for _ in range(4)]
        if i % 2:
            body.append("Terms and privacy, all rights kept.")
        texts.append("\n".join(body))
    texts += [texts[3], texts[3], texts[4] + "\nand one more", "short text", None, "spam spam spam " * 60, "x### " * 90]
    return [(i, t, "en", f"s{i % 13}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = documents()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    words = ALNUM_WORDS.findall(ascii_lower(rows[7][1]))
    spark.createDataFrame([(1, " ".join(words[10:40])), (2, "nothing of this kind is anywhere in there at all I am sure of it")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def fails(t: str | None) -> bool:
    n, chars, symbols, _, _, base = plain_quality(t)
    said = [x for x in (t or "").split("\n") if SPACE_WORDS.search(x)]
    capitals = sum("A" <= c <= "Z" for c in t or "")
    return base or 10 * symbols > n or 2 * (len(said) - len(set(said))) > len(said) or chars < 2 * n or chars > 12 * n or 2 * capitals > chars


def test_pipeline_is_its_plain_version(spark, folder):
    rows = [r for r in documents() if not fails(r[1])]
    sites = defaultdict(set)
    for r in rows:
        for x in r[1].split("\n"):
            sites[x.strip(" \t\n\x0b\f\r")].add(r[3])
    cut = []
    for r in rows:
        ls = r[1].split("\n")
        left = [x for x in ls if not x.strip() or len(sites[x.strip(" \t\n\x0b\f\r")]) < 10]
        cut.append((r[0], "\n".join(left) if 5 * (sum(map(len, ls)) - sum(map(len, left))) < 4 * sum(map(len, ls)) else r[1], r[3]))
    sets = [plain_shingles(t) for _, t, _ in cut]
    root = roots(len(cut), [(i, j) for i in range(len(cut)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))])
    single = [c for i, c in enumerate(cut) if root[i] == i]
    item = ALNUM_WORDS.findall(ascii_lower(documents()[7][1]))[10:40]
    phrases = {tuple(item[a : a + 13]) for a in range(18)}
    clean = []
    for d in single:
        ws = ALNUM_WORDS.findall(ascii_lower(d[1]))
        hit = {a + k for a in range(len(ws) - 12) if tuple(ws[a : a + 13]) in phrases for k in range(13)}
        if not (hit and 20 * len(hit) >= len(ws)):
            clean.append(d)
    assert len(rows) < len(documents()) - 2 and len(single) < len(cut) and len(clean) == len(single) - 1
    size = defaultdict(int)
    for d in clean:
        size[d[2]] += len(SPACE_WORDS.findall(d[1]))
    names = sorted(size)
    target = dict(zip(names, mixing.targets([size[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((g.doc_id, g.size, g.source_size) for g in got) == sorted((d[0], len(SPACE_WORDS.findall(d[1])), size[d[2]]) for d in clean)
    of = {d[0]: d[2] for d in clean}
    assert all(abs(g.target - target[of[g.doc_id]]) < 1e-6 and g.taken <= 2 * g.size for g in got)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_row", common.F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_labelled_documents(spark):
    """Of the labelled tables: low quality goes, and what goes of high quality fails a base rule."""
    d = "/root/testdata/sf0.01"
    judged = quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert judged.filter("quality = 0 and kept").count() <= 0.02 * judged.filter("quality = 0").count()
    assert judged.filter("quality = 1 and not kept and not base_failed").count() <= 0.01 * judged.count()


# --- helpers --------------------------------------------------------------------------------------------------------------

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1c\x85ab.Zé漢🙂\x00", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_are_the_pattern(texts):
    for kind, pattern in (("space", SPACE_WORDS), ("alnum", ALNUM_WORDS)):
        ws = common.words_of(pa.array(texts, pa.string()), common.separators(kind), lower=True)
        want = [pattern.findall(ascii_lower(t or "")) for t in texts]
        assert ws.counts.tolist() == [len(w) for w in want]
        assert [x.decode() for x in ws.strings().to_pylist()] == [x for w in want for x in w]
        if ws.n:
            assert common.spaced(ws.data, np.diff(ws.at)).tobytes().decode() == "".join(x + " " for w in want for x in w)
            keys = common.word_keys(ws)
            flat = [x for w in want for x in w]
            assert all((keys[i] == keys[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_slices_of_arrays():
    a = pa.array(["skip", "a b", None, "c"], pa.string()).slice(1)
    ws = common.words_of(a, common.separators("space"))
    assert ws.counts.tolist() == [2, 0, 1] and ws.strings().to_pylist() == [b"a", b"b", b"c"]


def test_long_words_have_keys():
    texts = pa.array(["x" * 10000 + " " + "x" * 10001 + " y", "x" * 10000], pa.string())
    k = common.word_keys(common.words_of(texts, common.separators("space")), )
    assert k[0] == k[3] and len(set(k.tolist())) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40)), max_size=30), st.integers(1, 60), st.integers(1, 7))
def test_streams_keep_every_row(rows, size, step):
    rows = sorted(rows)
    t = pa.table({"k": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array(["x" * n for _, n in rows], pa.string())})
    batches = [b for i in range(0, len(rows), step) for b in t.slice(i, step).to_batches()]
    groups = list(common.grouped_stream(iter(batches), "k"))
    assert [g["k"][0].as_py() for g in groups] == sorted({k for k, _ in rows}) and sum(g.num_rows for g in groups) == len(rows)
    parts = list(common.chunks(iter(batches), "text", size))
    assert pa.concat_tables(parts)["text"].to_pylist() == t["text"].to_pylist() if parts else not rows
    assert all(sum(map(len, p["text"].to_pylist()[:-1])) < size for p in parts)


def test_ranges():
    assert common.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11] and len(common.ranges(np.zeros(0), np.zeros(0, int))) == 0


# --- near copies of the pipeline's stage ----------------------------------------------------------------------------------


def plain_shingles(t: str | None) -> frozenset:
    ws = SPACE_WORDS.findall(ascii_lower(t or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


@pytest.mark.parametrize("hot,shingles,rows", [(48, 400_000, 1024), (2, 300, 3), (2, 400_000, 1024)])
@pytest.mark.parametrize("early", [True, False])
def test_near_dedup_is_brute_force(spark, hot, shingles, rows, early, monkeypatch):
    """Similarities on both sides of 0.8, in groups and chains; by pairs and by blocks, also where the earlier turns find nothing."""
    for name, value in (("HOT", hot), ("BLOCK_SHINGLES", shingles), ("BLOCK_ROWS", rows)):
        monkeypatch.setattr(jaccard, name, value)
    if not early:
        for name in ("_by_fingerprint", "_with_pivots"):
            monkeypatch.setattr(jaccard, name, lambda df: df.sparkSession.createDataFrame([], "a long, b long"))
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    texts: list[str | None] = [None, "", " ", "one two", "One  two", "one three"]
    for _ in range(12):
        ws = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(1, 9)):
            texts.append(" ".join(ws))
            ws = list(ws)
            for _ in range(r.randint(1, 3)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
    sets = [plain_shingles(t) for t in texts]
    # 9 * both >= 4 * (n + m) is a Jaccard similarity of 0.8 in whole numbers.
    root = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {g.doc_id: g.component_id for g in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root)) and 12 < len(set(root)) < len(texts) - 12
    far = [(i, j) for i in range(len(texts)) for j in range(i) if root[i] == root[j] and (plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).bit_count() > 4]
    assert far, "the rule of op9 would have lost some"


def test_blocks_find_what_pairs_find():
    """One cell against plain set arithmetic."""
    r = random.Random(2)
    for _ in range(30):
        base = [r.randrange(500) for _ in range(30)]
        sets = [sorted(set([x if r.random() < 0.9 else r.randrange(500) for x in base])) for _ in range(r.randint(2, 12))]
        right = np.array([r.random() < 0.5 for _ in sets])
        root = np.array([r.randrange(4) for _ in sets])
        cls = np.arange(100, 100 + len(sets))
        a, b = jaccard.compared(cls, root, right, pa.array(sets, pa.list_(pa.int64())))
        want = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if not right[i] and right[j] and root[i] != root[j] and 9 * len(set(sets[i]) & set(sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
        assert roots(len(sets), [(x - 100, y - 100) for x, y in zip(a.tolist(), b.tolist())]) == roots(len(sets), want)


def test_spared_pages(spark):
    """Pages of which boilerplate makes up a share keep their text; below it, the lines go."""
    r = random.Random(4)
    page = lambda n: [" ".join(f"v{r.randrange(900)}" for _ in range(12)) for _ in range(n)]
    notice, copied = page(6), page(12)
    rows = [(i, "\n".join([*notice, " ".join(f"own{i}x{k}" for k in range(20))]), f"s{i}") for i in range(12)]
    rows += [(20 + i, "\n".join([*copied, f"seen {i}"]), f"s{i}") for i in range(12)]
    rows += [(40, "\n".join(notice), "s1"), (41, None, "s2"), (42, "\n".join([*notice[:1], *page(5)]), "s3"), (43, "", "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {g.doc_id: g for g in lines.remove_boilerplate(docs, spare=0.8).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        cut = i < 12 or i == 42
        assert got[i].text == ("\n".join(x for x in text.split("\n") if x not in notice) if cut else text), i
        assert got[i].n_removed == (6 if i < 12 else 1 if i == 42 else 0)
    every = {g.doc_id: g for g in lines.remove_boilerplate(docs).collect()}
    assert every[40].text == "" and every[20].text == "seen 0" and every[41].text is None


def test_fingerprints_of_a_long_text_are_summed_in_pieces():
    r = np.random.default_rng(3)
    sizes = np.array([0, 5, 700, 0, 1, 30, 0])
    h = r.integers(0, 2**63, int(sizes.sum()), dtype=np.uint64)
    want = simhash.majority(h, sizes)
    assert all((simhash.majority(h, sizes, n) == want).all() for n in (1, 7, 64, 701))
    first = np.r_[0, np.cumsum(sizes)]
    assert want.tolist() == [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:z]) > z - a) for a, z in zip(first, first[1:])]
