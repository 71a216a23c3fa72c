"""The corpus operators against brute force, on the small tables and on awkward rows."""

import hashlib
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metricgraph.llm import common, decontaminate, fingerprints, lines, near, quality, shards, suffixes, tokens, toxicity, wordbpe

PATH = common.vocabulary_path()
LONG = " ".join(f"word{i % 700} thing" for i in range(12_000))
PASSAGE = " ".join(f"passage{i} of" for i in range(40))
#: Nulls, empty and blank texts, repeats, ties, a very long text, special strings, other scripts.
AWKWARD = [
    (1, "The cat sat on the mat with the hat today.\nSecond line here is also quite long, truly."),
    (2, None),
    (3, ""),
    (4, "  \n\n"),
    (5, LONG),
    (6, LONG + " end"),
    (7, "The cat sat on the mat with the cap today.\nshort"),
    (8, "<|endoftext|>Hello ΣΑΣ <|startoftext|><|ENDOFTEXT|> İstanbul's 42 ａｂｃ \U0001e5ea\x1c ñandú 日本語 é"),
    (9, "The cat sat on the mat with the hat today.\nSecond line here is also quite long, truly."),
    (10, PASSAGE + " a tail of its own"),
    (11, "a head of its own " + PASSAGE),
    (12, "one"),
    (13, "one"),
    (14, "one"),
    (15, "xy" * 400),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """With extra columns whose names the operators use themselves."""
    rows = [(d, t, "x", 1, "s", i, "w", 0.5, "g") for i, (d, t) in enumerate(AWKWARD)]
    schema = "doc_id long, text string, row_key string, key int, spans string, n long, words string, features double, gone string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return common.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def repeated(spark):
    """Null and repeated ids, repeated rows."""
    return spark.createDataFrame([(None, PASSAGE), (7, PASSAGE), (7, PASSAGE), (7, "other words in this row entirely"), (None, None)], "doc_id long, text string")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def library(texts):
    return Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_tokens_equal_the_library(request, table):
    docs = request.getfixturevalue(table)
    got = rows(tokens.encode(docs, PATH, digests=True), "n_tokens", "ids_sha256", "decoded_sha256")
    counted = rows(tokens.count_tokens(docs, PATH), "n_bytes", "n_tokens", "over_limit")
    tok, data = Tokenizer.from_file(PATH), pairs(docs)
    for (d, t), e in zip(data, library([t for _, t in data]), strict=True):
        ids = np.array(e.ids, "<u4").tobytes()
        decoded = tok.decode(e.ids, skip_special_tokens=False)
        assert got[d] == (len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), d
        assert counted[d] == (len((t or "").encode()), len(e.ids), len(e.ids) > 2048), d


def test_encode_then_decode(spark, awkward, empty):
    whole = tokens.encode(awkward, PATH)
    assert rows(tokens.decode(whole, PATH), "decoded") == rows(whole, "decoded")
    assert tokens.encode(empty, PATH).count() == 0


def test_unicode_words_equal_the_library():
    tok, v = Tokenizer.from_file(PATH), wordbpe.vocabulary(PATH)
    rng = np.random.default_rng(0)
    chars = [chr(c) for c in rng.integers(0x20, 0x30000, 4000) if not 0xD800 <= c <= 0xDFFF] + list(" \t\u0085 'sΣİ" * 20)
    for _ in range(60):
        text = "".join(rng.choice(chars, 40))
        words = [w for c in v.chunks(text) for w in v.pieces(c)]
        ids = [i for a in wordbpe.encode_words(v, words) for i in a.tolist()]
        assert ids == tok.encode(text, add_special_tokens=False).ids, text
        chunks = v.chunks(text)
        assert shards.library_chunks(v, chunks) == tokens.encode_chunks(v, chunks), text


@pytest.mark.parametrize("shingle", [2, 5])
@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_near_duplicates(request, table, shingle):
    docs = request.getfixturevalue(table)
    got = rows(near.near_duplicates(docs, shingle, 80), "n_shingles", "component")
    assert got == brute.near(pairs(docs), shingle, 80)


def test_near_duplicates_with_hot_values(spark, monkeypatch):
    """Many documents share a passage; some are near copies of each other besides."""
    monkeypatch.setattr(near, "HOT_LEAST", 5)
    monkeypatch.setattr(near, "HOT_SHARE", 0.0)
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(5000)}" for _ in range(60)) for _ in range(12)]
    data = []
    for i in range(120):
        words = base[i % 12].split()
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"e{i}x{rng.integers(9)}"
        data.append((i, PASSAGE + " " + " ".join(words) if i % 3 else " ".join(words)))
    got = rows(near.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2, 80), "n_shingles", "component")
    assert got == brute.near(data, 2, 80)


def test_near_duplicates_of_short_texts_with_hot_values(spark, monkeypatch):
    """Five shingles, two of them hot, against four of these: every pair is linked, whatever the order of the hashes."""
    monkeypatch.setattr(near, "HOT_LEAST", 5)
    monkeypatch.setattr(near, "HOT_SHARE", 0.0)
    data = []
    for i in range(60):
        data += [(2 * i, f"all rights reserved x{i} y{i} z{i}"), (2 * i + 1, f"all rights reserved x{i} y{i}")]
    got = rows(near.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 2, 80), "n_shingles", "component")
    assert got == brute.near(data, 2, 80)
    assert all(got[2 * i + 1] == (4, 2 * i) for i in range(60))


def test_near_duplicates_without_chances(spark, documents, awkward, monkeypatch):
    """The exact mode finds every link, also where the sketches' keys bring nothing together."""
    data = [(i, " ".join(f"w{(i // 6 * 37 + j * (1 + i // 6)) % 4001 if j != i % 6 * 7 else -i - 1}" for j in range(60))) for i in range(180)]
    data += [(1000 + i, PASSAGE + f" own{i} own{i + 1} own{i % 3}") for i in range(60)]
    made = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(near, "BLOCK", 16)
    # One value has no successor: with 1 there are no keys at all.
    for most, docs, shingle, percent in ((near.COLD_VALUES, documents, 5, 80), (1, made, 2, 80), (1, awkward, 2, 80), (1, made, 1, 50)):
        monkeypatch.setattr(near, "COLD_VALUES", most)
        monkeypatch.setattr(near, "FULL_VALUES", most)
        got = rows(near.near_duplicates(docs, shingle, percent, exact=True), "n_shingles", "component")
        assert got == brute.near(pairs(docs), shingle, percent)
    assert rows(near.near_duplicates(made, 2, 80), "n_shingles", "component") != brute.near(data, 2, 80)


def test_near_duplicates_without_chances_of_nothing(empty, repeated):
    assert near.near_duplicates(empty, exact=True).count() == 0
    assert near.keep_one(empty, exact=True).count() == 0
    assert near.keep_one(repeated, exact=True).count() == 3


def test_near_duplicates_of_nothing_and_repeats(empty, repeated):
    assert near.near_duplicates(empty).count() == 0
    got = near.near_duplicates(repeated).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 3
    assert near.keep_one(repeated).count() == 3


@pytest.mark.parametrize("near_words", [4, 8])
@pytest.mark.parametrize("table", ["documents", "awkward", "short"])
def test_lines(spark, request, table, near_words):
    """Exact repeats of every line that is not blank, near ones from so many words on, against brute force."""
    docs = spark.createDataFrame(SHORT, "doc_id long, text string") if table == "short" else request.getfixturevalue(table)
    data = pairs(docs)
    report, left = {}, {}
    for d, gone in brute.lines(data, near_words).items():
        text = dict(data)[d]
        parts = (text or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(parts) if i not in gone)
        report[d] = (len(parts), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        if not gone or kept.strip(" \t\n\x0b\f\r"):
            left[d] = kept if gone else text
    assert rows(lines.line_report(docs, near_words), "n_lines", "n_removed", "kept_sha256") == report
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, near_words).collect()} == left


def test_lines_of_nothing_and_repeats(empty, repeated, awkward):
    assert lines.line_report(empty).count() == lines.dedup_lines(empty).count() == 0
    assert sorted(r["n_removed"] for r in lines.line_report(repeated).collect()) == [0, 0, 0, 1, 1]
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(awkward).collect()}
    assert set(kept) == {d for d, _ in AWKWARD} - {6, 9, 13, 14} and kept[7] == "short" and kept[2] is None


SHORT = [
    (1, "Les.\n\nAll rights reserved.\nfive words stand right here\n    \n    "),
    (2, "Les.\n\nAll rights reserved.\nfive words stood right here"),
    (3, "a b\nfive words right here\n\nall rights reserved."),
]


def test_pipeline_takes_short_lines(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(SHORT, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.line_stage(spark, docs, "").collect()} == {1, 3}


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_suffixes(request, table, monkeypatch):
    docs = request.getfixturevalue(table)
    monkeypatch.setattr(suffixes, "BUCKET", 400)
    monkeypatch.setattr(suffixes, "PART", 60)
    got = rows(suffixes.suffix_report(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffixes(pairs(docs))


def test_suffixes_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 20)
    monkeypatch.setattr(suffixes, "PART", 6)
    data = [(i, f"{'ab' * (i % 7)} {PASSAGE} {i % 5} tail {'zy' * (i % 3)}") for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffixes.suffix_report(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffixes(data)


def test_suffixes_of_nothing_and_repeats(empty, repeated):
    assert suffixes.suffix_report(empty).count() == 0
    n = len(PASSAGE)
    assert sorted(r["n_removed"] for r in suffixes.suffix_report(repeated).collect()) == [0, 0, 0, n, n]
    kept = [bytes(r["kept"]) for r in suffixes.dedup_suffixes(repeated).collect()]
    assert sorted(map(len, kept)) == sorted([0, n, 0, 0, 32])


def test_parts_of_a_bucket_hold_whole_leads():
    rng = np.random.default_rng(3)
    lead = np.sort(np.append(rng.integers(0, 40, 300), [7] * 200))  # one lead is larger than a part
    cutter, parts = suffixes.WholeLeads(50), []
    for at in range(0, 500, 17):
        parts += cutter.add(pd.DataFrame({"lead": lead[at : at + 17]}))
    parts += cutter.rest()
    assert np.concatenate([p["lead"] for p, _, _ in parts]).tolist() == lead.tolist()
    assert len(parts) > 3 and len(set(lead)) == sum(p["lead"].nunique() for p, _, _ in parts)
    assert [b for _, b, _ in parts] == [True] + [False] * (len(parts) - 1) and [e for _, _, e in parts] == [False] * (len(parts) - 1) + [True]
    assert list(suffixes.WholeLeads(50).rest()) == []


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 4, 500) for _ in range(4)]
    order = suffixes.multikey_order(columns)
    ours = list(zip(*(c[order] for c in columns), strict=True))
    assert ours == sorted(zip(*columns, strict=True))


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_shards(spark, request, table):
    docs = request.getfixturevalue(table)
    data = sorted(pairs(docs))
    start, expected = 0, {}
    for (d, _), e in zip(data, library([t for _, t in data]), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        expected[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert rows(shards.round_trip(docs, PATH), "start", "n_tokens", "ids_crc32") == expected


def test_shard_lookup(spark, documents):
    folder = common.shared_folder(spark, "lookup")
    manifest = shards.write_shards(documents, folder, PATH, parts=3).collect()
    assert len(manifest) == 3
    for m in manifest:
        reader = shards.ShardReader(m["path"])
        for d in (m["first_key"], m["last_key"]):
            text = documents.filter(F.col("doc_id") == d).first()["text"]
            assert reader.get(d)[0].tolist() == [*library([text])[0].ids, 1]
        assert reader.get(10**9) == []
        reader.close()


def test_shards_of_nothing_and_repeats(spark, empty, repeated):
    assert shards.round_trip(empty, PATH).count() == 0
    got = shards.round_trip(repeated, PATH).collect()
    assert len(got) == 5 and sorted(r["start"] for r in got) == np.cumsum([0, *(r["n_tokens"] for r in sorted(got, key=lambda r: r["start"]))]).tolist()[:-1]


def test_shards_tell_the_least_id_from_none(spark):
    docs = spark.createDataFrame([(None, "b"), (-(2**63), "c"), (2**63 - 1, "d"), (None, "a")], "doc_id long, text string")
    got = sorted(shards.round_trip(docs, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -(2**63), 2**63 - 1]
    only = shards.write_shards(docs.filter("doc_id is null"), common.shared_folder(spark, "keyless"), PATH).collect()
    assert [(r["part"], r["keyless"], r["n_docs"]) for r in only] == [(0, True, 2)]


def test_fingerprints(spark, awkward, empty, repeated):
    data = sorted(AWKWARD, reverse=True)
    got = rows(fingerprints.against_edits(awkward), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    for i, (d, t) in enumerate(data):
        t, following = t or "", data[(i + 1) % len(data)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, changed, after = map(fingerprints.fingerprint, (t, edited, following))
        assert got[d] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, fingerprints.likeness(own, changed), fingerprints.likeness(own, after)), d
    assert got[1][2] == got[9][2] and got[2][2] == ""
    assert fingerprints.against_edits(empty).count() == 0
    assert fingerprints.against_edits(repeated).count() == 5


def test_likeness_is_close_to_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.8, 1.0):
        errors = []
        for _ in range(20):
            both = [f"a{rng.integers(10**9)}" for _ in range(int(600 * share))]
            a, b = ([*both, *(f"{s}{rng.integers(10**9)}" for _ in range(600 - len(both)))] for s in "xy")
            sa, sb = (near.shingles([w.encode() for w in x], 5) for x in (a, b))
            truth = len(sa & sb) / len(sa | sb)
            errors.append(fingerprints.likeness(fingerprints.fingerprint(" ".join(a)), fingerprints.fingerprint(" ".join(b))) - truth)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


ITEMS = [(1, " ".join(f"passage{i} of" for i in range(3, 12))), (2, "cat sat"), (3, None), (4, ""), (5, "one"), (6, "cat sat")]


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_WORDS, 0])
def test_windows(spark, awkward, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(decontaminate.scan(awkward, items, limit=limit), "n_words", "n_hit", "n_items", "items_sha256")
    assert got == brute.windows(AWKWARD, ITEMS)
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(awkward, items, limit=limit).collect()}
    assert cleaned[1].startswith("The  on the mat") and cleaned[2] is None and 12 not in cleaned
    kept = {r["doc_id"] for r in decontaminate.decontaminate(awkward, items, mode="documents", limit=limit).collect()}
    assert kept == {2, 3, 4, 5, 6, 8, 15}
    assert decontaminate.decontaminate(awkward, items, limit=limit).columns == awkward.columns


def test_windows_of_nothing(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    for limit in (10, 0):
        assert decontaminate.scan(awkward, none, limit=limit).filter("contaminated").count() == 0
        assert decontaminate.scan(empty, spark.createDataFrame(ITEMS, "item_id long, text string"), limit=limit).count() == 0


def test_toxicity(spark, awkward, empty):
    """Fitted without a fifth of the labelled rows, which it is then held against."""
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    chain = toxicity.ToxicityChain.fit(docs, labels.filter(~held))
    found = chain.score(docs.filter(held)).join(labels, "doc_id")
    assert found.columns[1 : len(docs.columns)] == docs.columns[1:]
    said = found.select((F.col("p_toxic") >= 0.5).cast("int").alias("p"), "toxic").toPandas()
    assert said[said["toxic"] == 1]["p"].mean() >= 0.85
    assert said[said["toxic"] == 0]["p"].mean() <= 0.02
    assert chain.score(awkward).count() == len(AWKWARD) and chain.score(empty).count() == 0
    assert chain.score(awkward).columns[: len(awkward.columns)] == awkward.columns


def test_without_labels(spark, awkward):
    """No labelled rows, and labels of one sort only: a defined result from every classifier."""
    some = [d for d, _ in AWKWARD]
    for values, score in (([], 0.5), ([(d, 0, 0) for d in some], 0.001), ([(d, 1, 1) for d in some], 0.999)):
        labels = spark.createDataFrame(values, "doc_id long, quality int, toxic int")
        assert toxicity.toxicity(awkward, labels).filter("toxic or p_toxic > 0").count() == 0
        assert sorted(r["doc_id"] for r in toxicity.drop_toxic(awkward, labels).collect()) == some
        assert {round(r["score"], 6) for r in quality.quality(awkward, labels).collect()} == {score}


def test_quality(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    out = quality.quality(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert set(out["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out["doc_id"]]) == {True}
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    ensemble = quality.RuleEnsemble.fit(docs, labels)
    assert 0 < len(ensemble.rules) < 150
    scored = ensemble.score(awkward)
    assert scored.columns == [*awkward.columns, "score"] and scored.filter("score between 0 and 1").count() == len(AWKWARD)
    assert ensemble.score(empty).count() == 0


def test_rules_score_as_plain_python(spark, documents):
    """The compiled expression against the rules taken one by one over the statistics."""
    C = quality.Condition
    ensemble = quality.RuleEnsemble(-0.5, [(1.25, (C("log_chars", True, 6.0), C("upper_share", False, 0.03))), (-2.0, (C("digit_share", True, 0.01),)), (0.75, (C("distinct_share", False, 0.8),))])
    stats = documents.select("doc_id", *(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).collect()
    got = rows(ensemble.score(documents), "score")
    for r in stats:
        total = ensemble.intercept + sum(w for w, rule in ensemble.rules if all((r[c.feature] > c.value) == c.above for c in rule))
        assert abs(got[r["doc_id"]][0] - 1 / (1 + np.exp(-total))) < 1e-12


#: Every name that a stage or a scorer gives to a column of its own.
INTERNAL = "gone left row row_key line h1 h2 key _key _gone _spans _items _left _row _docs _word _bits _log_chars log_chars features words counts p_toxic kind_1 component kept rep hub id doc a.b x`y".split() + ["two words"]


@pytest.mark.parametrize("value", ["x", 1])
def test_stages_leave_other_columns_alone(spark, value):
    data = [(d, t, *(value for _ in INTERNAL)) for d, t in AWKWARD]
    schema = "doc_id long, text string, " + ", ".join(f"{common.quoted(c)} {'string' if value == 'x' else 'int'}" for c in INTERNAL)
    docs = spark.createDataFrame(data, schema)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d, _ in AWKWARD], "doc_id long, quality int, toxic int")
    stages = {
        "lines": lines.dedup_lines(docs),
        "near": near.keep_one(docs),
        "windows": decontaminate.decontaminate(docs, items),
        "joined windows": decontaminate.decontaminate(docs, items, limit=0),
        "toxic": toxicity.drop_toxic(docs, labels),
    }
    for name, out in stages.items():
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == value for r in found for c in INTERNAL), name
    scored = quality.RuleEnsemble(0.0, [(1.0, (quality.Condition("log_chars", True, 3.0),))]).score(docs)
    assert all(r[c] == value for r in scored.collect() for c in INTERNAL)


def test_rules_of_a_printed_forest():
    text = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 1 <= 2.0)\n      Predict: 1.0\n     Else (feature 1 > 2.0)\n      Predict: 0.0\n    Else (feature 0 > 0.5)\n     Predict: 0.0\n"
    rules = quality.tree_rules(text, ["a", "b"])
    assert [[(c.feature, c.above, c.value) for c in r] for r in rules] == [[("a", False, 0.5)], [("a", False, 0.5), ("b", False, 2.0)], [("a", False, 0.5), ("b", True, 2.0)], [("a", True, 0.5)]]


def test_pipeline(spark, sf):
    import corpus_pipeline

    documents = common.table(spark, sf, "documents")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf), name.replace(" ", "-"))
        assert out.columns == documents.columns, name
        assert out.count() <= docs.count()
        docs = out
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == docs.count() > 100


