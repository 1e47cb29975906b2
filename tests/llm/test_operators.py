"""Each operator against SQL or brute force, and on the cases that its docstring defines."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries as q
from palimpsest.llm.decontamination import decontaminate, with_leaks
from palimpsest.llm.exact_topk import exact_topk
from palimpsest.llm.jaccard_join import ngram_jaccard_join
from palimpsest.llm.katz import katz_scores
from palimpsest.llm.labels import held_out
from palimpsest.llm.license_scan import PHRASES, Scanner, with_licenses
from palimpsest.llm.mixing import Mix
from palimpsest.llm.quality import QualityModel, with_quality
from palimpsest.llm.substring_dedup import substring_dedup
from palimpsest.llm.token_counts import Counter as TokenCounter
from palimpsest.llm.token_counts import PieceModel, with_token_counts
from palimpsest.llm.toxicity import ToxicModel, with_toxicity

from ..conftest import SF, same

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
SCHEMA = "doc_id long, text string, source string, score double, n_words string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, f"s{i % 3}" if i % 4 else None, 1.0, "clash") for i, t in enumerate(texts)], SCHEMA)


def some_texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    long = [r.choice(vocabulary) for _ in range(80)]
    out = [None, "", " \t\n ", "one", "one two", "one two three", "a b c d", "A b C d", "ein übler Text"]
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(1, 90))]
        if i % 3 == 0:
            w = list(long[: r.randint(30, 80)])
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return [*out, out[-1], out[-1], " ".join(r.choice(vocabulary) for _ in range(5000)), "word " * 3000]


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert same(q.QUERIES[name](spark, SF), q.ORACLE_SQL[name])


def shingles(text, n):
    w = words_of((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components_by_force(texts, n, percent):
    sets, label = [shingles(t, n) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(spark, n, percent):
    texts = some_texts()
    rows = sorted(ngram_jaccard_join(docs_of(spark, texts), n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert [tuple(r)[1:] for r in rows] == components_by_force(texts, n, percent)


def test_jaccard_of_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(500)}"
        texts.append(" ".join(w))
    rows = sorted(ngram_jaccard_join(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id").collect())
    assert [tuple(x)[1:] for x in rows] == components_by_force(texts, 4, 85)


def test_units_of_deeply_nested_sets():
    from palimpsest.llm.jaccard_join import join_unit

    n = 3000
    sets = [np.arange(i + 1, dtype=np.uint64) for i in range(n)]  # each holds the one before
    pairs = join_unit(sets, list(range(n)), 85)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        assert 100 * min(len(sets[i]), len(sets[j])) >= 85 * max(len(sets[i]), len(sets[j]))
        root[find(i)] = find(j)
    want = list(range(n))  # a set links with those of 85 % of its size
    for i in range(1, n):
        if 100 * i >= 85 * (i + 1):
            want[i] = want[i - 1]
    assert len({(find(i), want[i]) for i in range(n)}) == len(set(want))


@pytest.mark.parametrize("cluster", [4, 12, 3072])
def test_jaccard_of_clusters_in_bands_of_sizes(spark, monkeypatch, cluster):
    from palimpsest.llm import jaccard_join

    for name, value in (("CLUSTER", cluster), ("LIGHT", 2), ("PIVOT_ROUNDS", 0), ("UNIT", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(13)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for _ in range(110):  # a shared head of many lengths, with changes
        w = base[: r.randint(12, 70)]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        texts.append(" ".join(w))
    rows = sorted(ngram_jaccard_join(docs_of(spark, texts), 2, 70).select("doc_id", "n_shingles", "component_id").collect())
    assert [tuple(x)[1:] for x in rows] == components_by_force(texts, 2, 70)


@pytest.mark.parametrize("middle,pivots", [(2, 0), (6, 0), (30, 1), (256, 0)])
def test_jaccard_of_shingles_counted_by_pairs(spark, monkeypatch, middle, pivots):
    from palimpsest.llm import jaccard_join

    for name, value in (("CLUSTER", 4), ("LIGHT", 2), ("PIVOT_ROUNDS", pivots), ("UNIT", 4), ("MIDDLE", middle)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(17)
    bases = [[f"w{r.randrange(25)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for _ in range(110):
        w = bases[r.randrange(6)][: r.randint(12, 60)]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"w{r.randrange(25)}"
        texts.append(" ".join(w))
    rows = sorted(ngram_jaccard_join(docs_of(spark, texts), 2, 70).select("doc_id", "n_shingles", "component_id").collect())
    assert [tuple(x)[1:] for x in rows] == components_by_force(texts, 2, 70)


def test_jaccard_joins_no_whole_clusters_of_chance_shingles(spark, monkeypatch):
    """Texts that share a few shingles by chance are told apart by counts, and no set is sent out for them."""
    from palimpsest.llm import jaccard_join

    joined, was = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: joined.append(edges.count()) or was(edges))
    r = random.Random(19)
    texts = []
    for i in range(200):  # each shingle of the pool is in 20 texts, and ties all to all
        pool = [f"p{(i + 10 * k) % 100}a p{(i + 10 * k) % 100}b" for k in range(10)]
        r.shuffle(pool)
        texts.append(" ".join(f"{x} u{i}x{k}" for k, x in enumerate(pool)))
    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "prefixes", lambda h, off, busy, percent: (np.arange(len(h)), np.repeat(np.arange(len(off) - 1), np.diff(off))))  # the order by which chance is worst
    rows = sorted(ngram_jaccard_join(docs_of(spark, texts), 2).select("doc_id", "n_shingles", "component_id").collect())
    assert [tuple(x)[1:] for x in rows] == components_by_force(texts, 2, 85)
    assert sum(joined) == 0  # ties of clusters among them


@pytest.mark.parametrize("few", [0, 40, 1 << 18])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "FEW", few)
    r = random.Random(23)
    path = r.sample(range(-500, 500), 120)  # long, in no order
    edges = [*zip(path, path[1:], strict=False), *((5000, 5000 + i) for i in range(1, 60)), *((r.randrange(9000, 9060), r.randrange(9000, 9060)) for _ in range(40)), (7, None), (1 << 62, -(1 << 62)), (1 << 62, -(1 << 62))]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    new = spark.createDataFrame(edges, "a long, b long")
    labels = common.components(new)
    assert dict(map(tuple, labels.collect())) == root and labels.count() == len(root)
    first = common.components(new.where("pmod(a, 2) = 0"))
    both = common.connected(first, new.where("pmod(a, 2) = 1"))
    loops = {a for a, b in edges if a == b and a not in root}
    assert {x: y for x, y in both.collect() if x not in loops} == root and both.count() == len(root) + len(loops & {a for a, _ in edges if a % 2})
    assert common.connected(labels, new.limit(0)).count() == len(root)
    assert common.components(new.limit(0)).count() == 0


def test_components_of_few_edges_take_few_jobs(spark):
    """Rounds as plans of their own, some twenty of them for this path, fill the driver with plans and code."""
    from palimpsest.llm.common import components

    path = random.Random(29).sample(range(2000), 2000)
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        labels = components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8
    assert labels.where("label <> 0").isEmpty() and labels.count() == 2000


def test_jaccard_leaves_no_sets_on_disk(spark, monkeypatch):
    import os

    from palimpsest.llm import jaccard_join

    stored, checkpointed = [], jaccard_join.checkpointed

    def kept(df):
        out = checkpointed(df)
        if "shingles" in out.columns:
            stored.extend(x.removeprefix("file://") for x in out.inputFiles())
            assert all(map(os.path.exists, stored))
        return out

    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "checkpointed", kept)
    texts = [" ".join(f"w{i // 5}x{k}" if k != i else "new" for k in range(40)) for i in range(30)]
    rows = ngram_jaccard_join(docs_of(spark, texts)).select("doc_id", "n_shingles", "component_id")
    assert stored and not any(map(os.path.exists, stored))
    assert [tuple(x)[1:] for x in sorted(rows.collect())] == components_by_force(texts, 4, 85)


def test_jaccard_of_repeated_and_missing_ids(spark):
    t = "a b c d e f"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, "x y"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_jaccard_join(df).collect()) == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "None")]
    assert ngram_jaccard_join(df.where("false")).count() == 0


def removed_by_force(texts, length):
    least = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        for p in range(len(w) - length + 1):
            least.setdefault(tuple(w[p : p + length]), i)
    out = []
    for i, t in enumerate(texts):
        w = words_of(t)
        gone = {p + k for p in range(len(w) - length + 1) if least[tuple(w[p : p + length])] < i for k in range(length)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("seed,length", [(7, 13), (3, 5), (4, 4)])
def test_substring_dedup(spark, seed, length):
    texts = some_texts(2)
    out = substring_dedup(docs_of(spark, texts), seed, length)
    assert out.columns == ["doc_id", "text", "source", "score", "n_words", "n_removed", "repeats"]
    assert [(r["n_words"], r["n_removed"], r["text"]) for r in sorted(out.collect(), key=lambda r: r["doc_id"])] == removed_by_force(texts, length)
    assert substring_dedup(docs_of(spark, texts).where("false")).count() == 0


def test_substring_dedup_of_repeated_and_missing_ids(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(3, t), (3, t), (None, t), (9, t), (9, "x " + t)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup(df).collect()) == [("3", 0), ("3", 0), ("9", 20), ("9", 20), ("None", 20)]


def tiles_by_force(item, text, least):
    """Greedy string tiling as it is defined: the longest match of unmarked words, the first of them, again and again."""
    mi, mt, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not mi[p + n] and not mt[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return out
        out.append((p, t, n))
        for k in range(n):
            mi[p + k] = mt[t + k] = True


def leaks_by_force(texts, items, least=5, threshold=0.8):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    out = []
    for d, text in enumerate(map(split, texts)):
        for i, words in ((i, split(x)) for i, x in items):
            got = tiles_by_force(words, text, min(least, len(words))) if words else []
            if got and sum(n for *_, n in got) >= threshold * len(words):
                out.append((d, i, sum(n for *_, n in got) / len(words), len(got), len(words), min(t for _, t, _ in got)))
    return sorted(out)


def test_decontamination_against_tiling_by_force(spark, monkeypatch):
    from palimpsest.llm import decontamination

    r = random.Random(12)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("xy")
    items = [(i, " ".join(word() for _ in range(r.randint(1, 24)))) for i in range(25)] + [(90, "ax " * 12), (91, "ax bx " * 6), (92, None), (93, ""), (1, "bx"), (94, "Ax, BX! " * 3 + "zz")]
    texts = [None, "", "ax " * 40, "bx ax " * 20]
    for _ in range(40):
        parts = [word() for _ in range(r.randint(0, 30))]
        for _, t in r.sample(items, 2):
            w = (t or "").split()
            cut = r.randint(0, len(w))
            parts += [*w[cut:], *[word() for _ in range(r.randint(0, 3))], *w[:cut]]
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for seeds in (7, 1_000_000):
        monkeypatch.setattr(decontamination, "SEEDS", seeds)
        index_rows = []
        for x in with_leaks(docs_of(spark, texts), bench).collect():
            index_rows += [(x["doc_id"], y["item_id"], y["coverage"], y["n_tiles"], y["n_words"], y["first_word"]) for y in x["leaks"]]
        assert sorted(index_rows) == leaks_by_force(texts, items)


def test_decontamination_of_a_word_that_text_and_item_repeat():
    from palimpsest.llm.decontamination import Index

    import time

    item, text = np.full(400, 7, np.uint64), np.full(20_000, 7, np.uint64)
    began = time.time()
    assert Index([5], [item], 5).leaks(text, np.array([0, len(text)]), 0.8) == {0: [(5, 1.0, 1, 400, 0)]}
    assert time.time() - began < 30


def test_decontamination_leaves_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "tiny one", "keep", 5), (2, "other words", "keep", 6)], "doc_id long, text string, _leaks string, _LEAKS_ long")
    out = decontaminate(df, spark.createDataFrame([(2, "tiny one")], "item_id long, text string"))
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(2, "other words", "keep", 6)]


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(30))
    half = item.split()
    texts = [None, "", "start " + item.upper() + "! end", " ".join(half[15:] + ["mid"] + half[:15]), " ".join(half[:20]), "tiny one", "clean text with words " * 50]
    bench = spark.createDataFrame([(1, item), (2, "tiny one"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    found = {r["doc_id"]: sorted(x["item_id"] for x in r["leaks"]) for r in with_leaks(docs_of(spark, texts), bench).collect()}
    assert found == {0: [], 1: [], 2: [1, 1], 3: [1, 1], 4: [], 5: [2], 6: []}
    assert sorted(r["doc_id"] for r in decontaminate(docs_of(spark, texts), bench).collect()) == [0, 1, 4, 6]
    assert with_leaks(docs_of(spark, texts), bench.where("false")).where(F.size("leaks") > 0).count() == 0
    assert with_leaks(docs_of(spark, []), bench).count() == 0


def test_exact_topk(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8)], "x") for i in range(300)]
    rows += [(300, None, "x"), (301, [1.0, None], "x"), (302, [float("nan")] * 8, "x"), (303, [], "x"), (None, [0.0] * 8, "x"), (304, rows[5][1], "x"), (306, [2.0, 3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for x in exact_topk(df, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    v = {i: np.floor(np.array(e) * 64) for i, e, _ in rows if i is not None and e and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e)}
    for i in range(0, 300, 20):
        want = sorted((-int(v[i] @ v[j]), j) for j in v if j != i)[:5]
        assert got[i] == [(j, -s) for s, j in want]
    assert set(got) == set(range(0, 300, 20))
    assert exact_topk(df.where("false"), df.where("false")).count() == 0


def test_quality_learns_and_scores_everything(spark):
    r = random.Random(0)
    good, bad = ["calm clear text", "well written line", "plain words here"], ["BUY!! NOW!!", "spam### click$$$", "la la la la"]
    texts = [" ".join(r.choice(good if i % 2 else bad) for _ in range(20)) for i in range(200)]
    model = QualityModel(bits=14).fit(texts[:150], np.array([i % 2 for i in range(150)], float))
    scores = model.score(pa.array(texts[150:]))
    assert all((s > 0.5) == bool(i % 2) for i, s in enumerate(scores))
    out = with_quality(docs_of(spark, some_texts()), model, as_col="score").collect()
    assert len(out) == len(some_texts()) and all(0 <= x["score"] <= 1 for x in out)
    assert QualityModel(bits=10).fit([], np.zeros(0)).score(pa.array(["x", None])).tolist() == [0.5, 0.5]


def test_toxicity_learns_words_by_their_stem(spark):
    r = random.Random(0)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]

    def text(toxic):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        for _ in range(2 * toxic):
            w[r.randrange(len(w))] = "vilest" + r.choice(vocabulary)[:3]
        return " ".join(w)

    labels = np.array([i % 4 == 0 for i in range(400)], float)
    texts = [text(int(y)) for y in labels]
    model = ToxicModel().fit(texts[:300], labels[:300])
    scores = model.score(pa.array(texts[300:]))
    assert np.mean((scores >= 0.5) == (labels[300:] == 1)) > 0.9
    assert ToxicModel().fit(texts[:3], np.ones(3)) is None
    out = {x["doc_id"]: x["score"] for x in with_toxicity(docs_of(spark, some_texts()), model, as_col="score").collect()}
    assert out[0] == out[1] == out[2] == 0 and all(0 <= s <= 1 for s in out.values())


def test_toxicity_gradients():
    from palimpsest.llm.labels import words_in
    from palimpsest.llm.toxicity import Inputs, _sigmoid

    m = ToxicModel()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    (_, w), = words_in(["one two three four", "five six"])
    x, at, mask = Inputs(w), np.zeros((4, 2), int), np.zeros((4, 2), bool)
    at[:, 0], mask[:, 0] = w.of[:4], True
    at[:2, 1], mask[:2, 1] = w.of[4:], True
    y, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = _sigmoid(m.read(m.gates(m.vectors(x)), at, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, i in (("hf", (0, 0)), ("hb", (1, 20)), ("xf", (3, 9)), ("att", (2, 3)), ("key", (1,)), ("out", (5,)), ("cb", (17,)), ("gram", (int(x.gram[0]), 2)), ("word", (int(x.word[0]), 1))):
        was = m.p[name][i]
        m.p[name][i] = was + 1e-5
        up = loss()
        m.p[name][i] = was - 1e-5
        down = loss()
        m.p[name][i] = was
        adam = {"t": 0}
        before = {k: v.copy() for k, v in m.p.items()}
        m._step(x, at, mask, y, weight, adam, 0.0)
        m.p = before
        assert adam[name][0][i] / 0.1 == pytest.approx((up - down) / 2e-5, abs=1e-4)


@pytest.fixture(scope="module")
def pieces():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark, pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    r = random.Random(4)
    texts = [*some_texts(), "▁ x ▁▁", "<s> </s><unk><0x41>", "日本語 한국어", "😀😀", "a" * 3000, " " * 700, "\t\r\n;\r\n", "x\x00y", "é" * 600]
    texts += ["".join(r.choice("abcdefghinorst_") for _ in range(n)) for n in (600, 5000, 20000)] + ["".join(r.choice(["the", "ing", "tion", "aa", "日本", "er"]) for _ in range(3000))]
    texts += ["".join(r.choice("abe  \n\r.;:{}09éü日😀▁") for _ in range(r.randint(0, 200))) for _ in range(300)]
    size, tokens = TokenCounter(PieceModel(pieces)).counts(pa.array(texts, pa.string()))
    assert tokens.tolist() == [len(library.encode(t or "")) for t in texts]
    assert size.tolist() == [len((t or "").encode()) for t in texts]
    out = with_token_counts(docs_of(spark, texts), pieces, 50)
    assert {x["doc_id"]: x["over_limit"] for x in out.collect()} == {i: int(n) > 50 for i, n in enumerate(tokens)}


def test_mix_meets_targets(spark):
    texts = ["w " * (20 * i % 700) for i in range(300)] + [None, ""]
    df = docs_of(spark, texts)
    mix = Mix(df, block=8)
    rows = mix.taken().collect()
    assert len(rows) == len(texts)
    size = {r["id"]: r["size"] for r in rows}
    assert size == {i: len(words_of(t)) for i, t in enumerate(texts)}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by, target, total = Counter(), {}, sum(size.values())
    for r in rows:
        by[r["source_no"]] += r["taken"]
        target[r["source_no"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(by[s] - t) <= 16 for s, t in target.items())
    spans = mix.spans().groupBy("id").agg(F.sum("words").alias("w")).collect()
    assert {r["id"]: r["w"] for r in spans} == {r["id"]: r["taken"] for r in rows if r["taken"]}
    assert sorted(map(tuple, Mix(df, block=8).taken().collect())) == sorted(map(tuple, rows))
    assert Mix(df.where("false")).taken().count() == 0
    assert [r["taken"] for r in Mix(df.where("doc_id >= 300")).taken().collect()] == [0, 0]


def test_mix_comes_near_the_targets_of_small_sources(spark):
    r = random.Random(8)
    sizes = [20, 20, 20, *(r.randint(1, 700) for _ in range(60)), 30_000]
    rows = []
    for i, n in enumerate(sizes):
        while n > 0:  # a source's words in documents of some length, and one id twice
            take = min(n, r.randint(1, 400))
            rows.append((len(rows) // 2, "w " * take, f"host{i:03d}"))
            n -= take
    got = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().collect()
    by, target, size = Counter(), {}, {}
    for x in got:
        assert x["taken"] <= 2 * x["size"]
        by[x["source_no"]] += x["taken"]
        target[x["source_no"]], size[x["source_no"]] = x["target"], x["source_size"]
    assert len(got) == len(rows) and [size[i + 1] for i in range(len(sizes))] == sizes
    for s, t in target.items():
        block = max(1, min(64, size[s] // 256))
        assert abs(by[s] - t) <= 1.5 * block, (s, size[s], t, by[s])
    three = spark.createDataFrame([(i, "w " * 20, "abc"[i]) for i in range(3)], "doc_id long, text string, source string")
    assert sorted((x["id"], x["taken"]) for x in Mix(three).taken().collect()) == [(0, 40), (1, 33), (2, 17)]


@pytest.mark.parametrize("order,buckets", [(1, 8), (2, 8), (3, 8), (3, 1), (4, 3)])
def test_katz_scores(spark, monkeypatch, order, buckets):
    from palimpsest.llm import katz
    from palimpsest.llm.katz import K_MAX, RESERVE, Unigrams, discounts

    monkeypatch.setattr(katz, "SLICE", 3000)
    monkeypatch.setattr(katz, "HOT", buckets)
    monkeypatch.setattr(katz, "RANGE", 500)
    texts = some_texts(5)
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in katz_scores(df, F.col("doc_id") % 5 == 1, order).collect()}
    tokens = [[*words_of((t or "").translate(LOW)), None] for t in texts]
    train = [i for i in range(len(texts)) if i % 5 != 1]
    c, grams = Counter(), {k: Counter() for k in range(2, order + 1)}
    for i in train:
        c.update(tokens[i])
        marked = (0, *tokens[i])
        for k in grams:
            grams[k].update(marked[j : j + k] for j in range(len(marked) - k + 1))
    n, v = sum(c.values()), len(c)
    times = lambda counts: [float(sum(x == r for x in counts.values())) for r in range(K_MAX + 2)]
    u, d = Unigrams.of(n, v, times(c)), {k: discounts(times(x)) for k, x in grams.items()}
    after = defaultdict(dict)
    for k in grams:
        for g, m in grams[k].items():
            after[g[:-1]][g[-1]] = m

    def p(h, w):
        if not h:
            return float(u.p(np.array([c.get(w, 0)]))[0])
        if h not in after:
            return p(h[1:], w)
        total, dk = sum(after[h].values()), d[len(h) + 1]
        free = sum((1 - dk[min(k, K_MAX + 1)]) * k for k in after[h].values()) / total
        least = RESERVE / (total + RESERVE)
        scale, free = (1, free) if free >= least else ((1 - least) / (1 - free), least)
        k = after[h].get(w, 0)
        if k:
            return dk[min(k, K_MAX + 1)] * k / total * scale
        if h not in unseen:
            unseen[h] = 1 - sum(p(h[1:], x) for x in after[h])
        return free / unseen[h] * p(h[1:], w)

    unseen = {}
    for h in [(), *list(after)[:20], *list(after)[-20:]]:
        assert sum(p(h, w) for w in c) + p(h, "unknown word") == pytest.approx(1)
    for i, t in enumerate(tokens):
        r, marked = got[i], (0, *t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 5 == 1, len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p(marked[max(0, j - order + 1) : j], marked[j])) for j in range(1, len(marked))))
    assert katz_scores(df.where("false"), F.lit(False), order).count() == 0
    alone = katz_scores(df.where("doc_id = 6"), F.lit(True), order).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and alone["score"] == 0


def test_katz_scores_of_one_id_on_two_texts_and_of_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "c b a"), (2, "a b c"), (2, "a b c"), (None, "a b"), (None, None), (7, "")]
    got = katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 2).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["held_out"]) for r in got) == sorted((str(i), len(words_of(t)) + 1, i == 2) for i, t in rows)
    assert {r["train_tokens"] for r in got} == {4 + 4 + 3 + 1 + 1}


def test_license_scan(spark):
    texts = [*some_texts(6), "Released under the MIT License.", "x under the mit license under the MIT license", "licensed under CC BY-NC 4.0 and the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3.", "the mit the license under of", "under the mit " * 50]
    got = sorted(with_licenses(docs_of(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for t, r in zip(texts, got, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        places = sorted((i, label) for text, label in PHRASES for i in range(len(w)) if w[i : i + len(text.split())] == text.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert [r["labels"] for r in got][-6:-2] == ["mit", "mit", "apache-2,cc-by-nc", "gpl-3"]
    assert Scanner().texts(pa.array([], pa.string())) == []


def test_license_spans_are_those_of_chains():
    notice = "This work is licensed under the GNU General Public License, version 3."
    fill = " ".join(f"w{i}" for i in range(500))
    (row,) = Scanner().texts(pa.array([f"{fill} {notice} {fill} {notice} end"]))
    spans = [x for x in row[-1] if x[0] == "gpl-3"]
    assert [(a, b) for _, a, b, _ in spans] == [(500, 511), (1012, 1023)] and all(share == 1.0 for *_, share in spans)
    from palimpsest.llm.license_scan import TEMPLATES

    for text, label in TEMPLATES:
        (row,) = Scanner().texts(pa.array([f"x {text} y"]))
        assert label in row[5].split(",") and row[6] == 1.0
        words = text.split()
        (row,) = Scanner().texts(pa.array([" ".join([*words[: len(words) // 2], "stranger", *words[len(words) // 2 :]])]))
        assert len(words) < 30 or label in row[5].split(",")


def test_license_chains_against_all_chains_by_force():
    from itertools import combinations

    r, scanner = random.Random(2), Scanner()
    for _ in range(200):
        size = r.randint(4, 14)
        anchors = []
        for _ in range(r.randint(1, 6)):
            n = r.randint(1, 5)
            anchors.append((r.randint(0, 25), n, r.randint(n, max(n, size))))
        best = 0
        left = sorted(set(anchors))
        for k in range(1, len(left) + 1):
            for chain in combinations(left, k):
                total, ok = chain[0][1], True
                for (b, m, e), (a, n, end) in zip(chain, chain[1:], strict=False):
                    new = min(n, end - e, a + n - b - m)
                    ok &= new > 0 and b < a <= b + 2 * size and e < end
                    total += new
                best = max(best, total if ok else 0)
        assert scanner.chains(anchors, size)[0][0] == pytest.approx(min(1.0, best / size))


def test_held_out_folds(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert {r["doc_id"]: r["h"] for r in df.select("doc_id", held_out().alias("h")).collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    out = c.run(spark, SF)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= 200
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t, "en", "a", 5), (2, t, "en", "a", 5), (2, t, "en", "a", 5), (None, t, None, None, None), (4, None, "x", "y", 0), (5, " ", "x", "y", 1), (5, " ", "x", "y", 1), (6, "z " + t[:-3] + " q", "en", "b", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in c.drop_near_copies(spark, docs, SF).collect()) == ["1", "4", "5", "5"]
    cut = sorted(c.cut_repeats(spark, docs, SF).collect(), key=str)
    assert len(cut) == 8 and c.cut_repeats(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("long_label", [0, 1])
def test_one_long_text_leaves_the_sample_to_others(spark, long_label):
    from palimpsest.llm.labels import SAMPLE_BYTES, TEXT_BYTES, training_sample

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    ids = [r["doc_id"] for r in labels.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    long = next(i for i in ids if i % 2 == long_label)  # the first of its label in hash order
    texts = {i: "some words" for i in range(60)} | {long: "start " + "middle \u4e2d" * 1_200_000 + " end"}
    got = {r["doc_id"]: r for r in training_sample(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels, "toxic").collect()}
    assert sorted(got) == sorted(ids)
    assert sum(len(r["text"].encode()) for r in got.values()) <= SAMPLE_BYTES
    text = got[long]["text"]
    assert len(text.encode()) <= TEXT_BYTES and text.startswith("start ") and text.endswith(" end")


def test_long_words_are_read_whole():
    from palimpsest.llm.labels import words_in

    r = random.Random(3)
    long = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(4000))
    for text in [long, "x" * 24, "y" * 25, "a b " + long[:9] + " c", "".join(r.choice("abcdef") for _ in range(61))]:
        (_, w), = words_in([text, "next"])
        cut = lambda data, k: {data[i : i + k] for i in range(len(data) - k + 1)}
        pieces = [bytes(w.buf[s:e]) for s, e in zip(w.starts[: w.first[1]], w.ends[: w.first[1]], strict=True)]
        assert max(map(len, pieces)) <= 24
        assert set().union(*(cut(p, 5) for p in pieces)) == set().union(*(cut(x.encode(), 5) for x in text.split(" ")))
        assert bytes(w.buf[w.starts[w.first[1]] : w.ends[w.first[1]]]) == b"next" and w.first[2] == len(w.starts)
        owner, keys = w.grams((3,), lambda k: k & np.uint64(0xFFFF))
        assert np.bincount(owner, minlength=len(w.distinct)).tolist() == [int(w.ends[i] - w.starts[i]) for i in w.example]


def test_toxic_stem_late_in_a_text_without_spaces():
    r = random.Random(0)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    plain = [[r.choice(vocabulary) for _ in range(r.randint(20, 60))] for _ in range(400)]
    labels = np.array([i % 4 == 0 for i in range(400)], float)
    texts = [" ".join([*w[:9], *["vilest" + w[0][:3]] * int(y), *w[9:], *["vilest" + w[1][:3]] * int(y)]) for w, y in zip(plain, labels, strict=True)]
    model = ToxicModel().fit(texts, labels)
    clean, toxic = ["_".join(w) for w in plain[:80]], ["_".join([*w[:15], "vilest", "vilest", "vilest", *w[15:]]) for w in plain[:80]]
    score = model.score(pa.array(clean + toxic))
    assert np.mean(score[80:] > score[:80]) > 0.9 and score[80:].mean() > score[:80].mean() + 0.2


def test_exact_topk_asks_a_query_once_whatever_its_block(spark, monkeypatch):
    from palimpsest.llm import exact_topk as module

    monkeypatch.setattr(module, "BLOCK", 2)
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(80)], "vec_id long, embedding array<double>").cache()
    asked = df.where("vec_id % 20 = 0").coalesce(1)
    rows = lambda q: sorted(map(tuple, exact_topk(df, q, 5).collect()))
    once = rows(asked)
    assert len(once) == 20 and rows(asked.union(asked).coalesce(1)) == once


def test_toxicity_fits_on_every_window(monkeypatch):
    from palimpsest.llm import toxicity

    seen = []
    scores = ToxicModel._scores
    monkeypatch.setattr(ToxicModel, "_scores", lambda self, x, at, mask: seen.append(at.shape[1]) or scores(self, x, at, mask))
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(48 + 32 * 59)) for _ in range(2)] + ["same " * 500]
    n = [len(toxicity.windows_of(x.first)[0]) for t in texts for _, x in toxicity.words_in([t])]
    assert n == [60, 60, 1 + -(-(500 - 48) // 32)]
    ToxicModel().fit(texts, np.array([1.0, 0.0, 0.0]))
    assert set(seen) == {sum(n)}


def test_toxicity_scores_the_highest_of_all_windows():
    r = random.Random(6)
    model = ToxicModel()
    model.p["out"] *= 5
    words = [f"w{r.randrange(900)}" for _ in range(700)] + ["same"] * 90
    starts = [*range(0, len(words) - 48, 32), len(words) - 48]
    parts = model.score(pa.array([" ".join(words[a : a + 48]) for a in starts]))
    assert model.score(pa.array([" ".join(words), None, ""])).tolist() == pytest.approx([parts.max(), 0, 0], abs=1e-5)
