"""Resampling, exact inner products and ranked search against brute force, on the small tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricgraph.llm import common, products, queries, ranking, resampling
from metricgraph.llm.balltree import LEAF, BallTree
from metricgraph.llm.select import kth_key, ranked
from metricgraph.llm.words import words

LONG = " ".join(f"word{i % 900} thing" for i in range(9_000))
TEXTS = [
    "The cat sat on the mat with the hat, and then the cat sat on another mat with 2 other hats.",
    None,
    "",
    " \n\t-- ",
    LONG,
    "ΣΑΣ İstanbul'S 42 ａｂｃ ñandú 日本語 É the THE tHe\x00nul",
    "x" * 3_000_000,
    *["ties of a text that many rows hold, word for word, twenty words at least so that it can be drawn as well as any"] * 12,
    *(f"filler number {i} about the cat and the mat, with words enough to be drawn by its score: a b c d e f g h" for i in range(60)),
]
ITEMS = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, "- -"), (5, "nowhere zzz"), (None, "日本語 thing word7 word8 the the"), (7, "ties of many rows")]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a null and repeats; extra columns with names that the operators use themselves."""
    ids = [None, *range(1, len(TEXTS) - 3), 7, 7, 9]
    data = [(d, t, "x", 1.5, "y", 3, "z", 4) for d, t in zip(ids, TEXTS, strict=True)]
    return spark.createDataFrame(data, "doc_id long, text string, row_key string, score double, `rank` string, n long, `a.b` string, bucket int").repartition(5)


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame([(1000 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id long, text string, item string")


def test_words():
    for t in TEXTS:
        assert [w.decode() for w in words(t)] == split(t)


def test_kth_key_and_ranks(spark):
    rng = random.Random(5)
    data = [(rng.choice([-3, 0, 0, 0, 7, 10**12]), i) for i in range(500)]
    keys = spark.createDataFrame(data, "score long, row_key long").repartition(3)
    order = sorted(data, key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 250, 333, 499, 500):
        assert kth_key(keys, k, pivots=4, seed=k) == order[k - 1]
    assert kth_key(keys, 0) is None and kth_key(keys, 501, pivots=4) is None and kth_key(keys.limit(0), 1) is None
    assert [(r["score"], r["row_key"]) for r in ranked(keys).orderBy("rank").collect()] == order
    assert [r["rank"] for r in ranked(keys).orderBy("rank").collect()] == list(range(1, 501))
    assert ranked(keys.limit(0)).count() == 0


def plain_resample(docs, target, runs, buckets, percent, least):
    def features(text):
        w = split(text)
        return [" ".join(w[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(x.encode()) % buckets for x in f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(repr, (r[:5] for r in out)))


@pytest.mark.parametrize(("which", "runs", "buckets", "percent", "least"), [("unique", (1, 1), 10_000, 10, 20), ("docs", (1, 1), 10_000, 50, 20), ("docs", (1, 3), 97, 30, 5), ("unique", (2, 2), 1, 100, 0)])
def test_resample(request, items, which, runs, buckets, percent, least):
    docs = request.getfixturevalue(which)
    found = resampling.resample(docs, items, runs, buckets, percent, least)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(repr(list(r)) for r in found.collect()) == plain_resample(data, [t for _, t in ITEMS], runs, buckets, percent, least)


def test_resample_of_nothing(spark, docs, items):
    assert resampling.resample(docs.limit(0), items).count() == 0
    alone = resampling.resample(docs, items.limit(0))
    assert alone.count() == len(TEXTS) and alone.filter("n_features = 0 and weight <> 0").count() == 0


def plain_products(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v], q) for i, v, q in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], not r[2]))
    out = []
    for at, (i, v, asks) in enumerate(sound):
        if asks:
            found = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), n) for n, (_, w, _) in enumerate(sound) if n != at))[:k]
            out += [(i, r + 1, sound[n][0], -s) for r, (s, n) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("values", [64, 400, products.BUCKET_VALUES])
@pytest.mark.parametrize("kind", ["lengths", "clusters", "awkward"])
def test_top_products(spark, kind, values):
    rng = np.random.default_rng(3)
    if kind == "lengths":
        data = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-2, 3)).tolist(), i % 20 == 0) for i in range(300)]
    elif kind == "clusters":
        centres = rng.normal(size=(6, 8))
        data = [(i, (v / np.linalg.norm(v)).tolist(), i % 20 == 0) for i in range(300) for v in [centres[i % 6] + 0.1 * rng.normal(size=8)]]
    else:
        data = [(i % 50 if i % 7 else None, [float(x) for x in rng.integers(-2, 3, size=4)], i % 10 == 0) for i in range(120)]
        data += [(5, None, True), (6, [1.0, None, 1.0, 1.0], True), (8, [float("nan")] * 4, True), (9, [float("inf"), 0.0, 0.0, 0.0], True), (10, [0.0] * 4, True), (11, [3.0], True), (12, [], True)]
        data += [(200 + i, [1.0, 2.0, 1.0, 0.5], False) for i in range(60)]
        data += [(300, [2.0**21, -(2.0**21), 1.0, 0.1], True), (301, [2.0**21 + 0.004, -(2.0**21), 1.0, 0.1], False)]
    table = spark.createDataFrame([(i, v, q, "x", 1, "b") for i, v, q in data], "vec_id long, embedding array<double>, q boolean, bucket string, theta int, vector string").repartition(3)
    found = products.top_products(table, F.col("q"), 5, bucket_values=values, query_values=40 if values == 64 else products.QUERY_VALUES)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_products(data, 5)
    assert products.top_products(table.limit(0), F.col("q")).count() == 0 and products.top_products(table, F.lit(None).cast("boolean")).count() == 0


def test_buckets_leave_vectors_out():
    """Close neighbours: sorted coordinates leave most of a bucket out; spread lengths: lengths do."""
    rng = np.random.default_rng(8)
    unit = np.repeat(rng.normal(size=(40, 16)), 25, 0) + 0.05 * rng.normal(size=(1000, 16))
    near = np.floor(256 * unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.int64)
    spread = (near * 10.0 ** rng.uniform(-3, 2, size=(1000, 1))).astype(np.int64)
    for vectors, share in ((near, 0.2), (spread, 0.3)):
        bucket, asked = products.Bucket(np.arange(1000), vectors), 0
        for q in range(0, 1000, 10):
            exact = vectors @ vectors[q]
            exact[q] = -(2**62)
            order = np.lexsort((np.arange(1000), -exact))[:5]
            keys, found = bucket.top(vectors[q], q, 5, int(exact[order[-1]]))
            assert keys.tolist() == order.tolist() and found.tolist() == exact[order].tolist()
            asked += 1000
        assert bucket.looked < share * asked


def plain_ranking(docs, items, k):
    docs = sorted(((d, split(t)) for d, t in docs if split(t)), key=lambda r: (r[0] is not None, r[0] or 0))
    N, L = len(docs), sum(len(w) for _, w in docs)
    tf = [Counter(w) for _, w in docs]
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, ((_, w), c) in enumerate(zip(docs, tf, strict=True)):
            m = 25 + 75 * len(w) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if s > 0:
                scores.append((-s, at))
        out += [(item, r + 1, docs[at][0], -s) for r, (s, at) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["unique", "docs"])
@pytest.mark.parametrize("item_words", [5, ranking.ITEM_WORDS])
def test_ranking(request, items, which, item_words, monkeypatch):
    docs = request.getfixturevalue(which)
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(ranking, "TREE_ENTRIES", 60)
    found = ranking.rank_documents(docs, items, 4, item_words)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranking(data, ITEMS, 4)


def test_ranking_of_nothing(docs, items):
    assert ranking.rank_documents(docs.limit(0), items).count() == 0
    assert ranking.rank_documents(docs, items.limit(0)).count() == 0


def test_ball_tree_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    starts, terms, values = [0], [], []
    for i in range(2_000):  # forty subjects with terms of their own, some rows repeated
        t = np.unique(np.concatenate((rng.integers(0, 30, 3), 30 + 40 * (i % 40) + rng.integers(0, 40, 12))))
        terms.append(t)
        values.append(rng.integers(1, 900_000, len(t)))
        if i % 5 == 4:
            terms[-1], values[-1] = terms[-2], values[-2]
        starts.append(starts[-1] + len(terms[-1]))
    scale = np.concatenate((np.full(30, 0.1), np.full(1600, 3.0)))
    tree = BallTree(np.array(starts), np.concatenate(terms), np.concatenate(values), scale)
    assert sorted(tree.order) == list(range(2_000)) and all(b - a <= LEAF for (a, b), c in zip(tree.span, tree.children, strict=True) if c[0] < 0)
    leaves, seen = sum(c[0] < 0 for c in tree.children), 0
    for q in range(50):
        asked = np.unique(np.concatenate((rng.integers(0, 30, 2), 30 + 40 * (q % 40) + rng.integers(0, 40, 8), [5000])))
        weights = np.where(asked < 30, 10, 9_000) * rng.integers(0, 3, len(asked))
        lookup = dict(zip(asked.tolist(), weights.tolist(), strict=True))
        exact = np.array([sum(int(v) * lookup.get(int(t), 0) for t, v in zip(ts, vs, strict=True)) for ts, vs in zip(terms, values, strict=True)])
        least = np.sort(exact)[-10]
        rows, found, looked = tree.search(asked, weights, 1, 10)
        assert set(np.flatnonzero(exact >= max(1, least))) == set(rows.tolist()) and (exact[rows] == found).all()
        seen += looked
    assert seen < 0.5 * 50 * leaves


@pytest.mark.parametrize("name", ["op11_resampling", "op12_top_products", "op13_ranked_search"])
def test_queries_as_brute_force(spark, sf, name):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    found = queries.QUERIES[name](spark, sf).collect()
    if name == "op11_resampling":
        assert sorted(repr(list(r)) for r in found) == plain_resample(docs, [t for _, t in items], (1, 1), 10_000, 10, 20)
    elif name == "op12_top_products":
        vectors = [(r["vec_id"], r["embedding"], r["vec_id"] % 50 == 0) for r in common.table(spark, sf, "embeddings").collect()]
        assert sorted(map(tuple, found), key=repr) == plain_products(vectors, 5)
    else:
        assert sorted(map(tuple, found), key=repr) == plain_ranking(docs, items, 10)
