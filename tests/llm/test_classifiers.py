"""Held-out accuracy of the trained models, edge cases, and the pipeline against its stages."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlab.llm import near_dup, packing, quality, substring, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_toxicity_held_out(spark):
    got = toxicity.op3_toxicity(spark, SF)
    assert got.count() == 10_000
    m = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y = m.toxic.to_numpy()
    hit = m.predicted.to_numpy()
    assert auc(m.score.to_numpy(), y) > 0.9
    assert (hit * y).sum() / y.sum() > 0.8 and (hit * y).sum() / hit.sum() > 0.75
    assert m.score.between(0, 1).all()


def test_quality_held_out(spark):
    got = quality.op4_quality_co_training(spark, SF)
    assert got.count() == 10_000
    m = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y = m.quality.to_numpy()
    assert auc(m.score.to_numpy(), y) > 0.99
    assert m[y == 1].keep.mean() > 0.98 and m[y == 0].keep.mean() < 0.1


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, None, None), (None, 1, 0)]])
def test_edges(spark, docs, labels):
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x"), (4, "long " * 40_000)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for out in (toxicity.scores(docs(rows, True), y), quality.scores(docs(rows, True), y)):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scores(docs([]), y).count() == 0
    assert quality.scores(docs([]), y).count() == 0


def bytes_of(text):
    """Of each place of a text: its byte if a letter's, else 0; a 0 behind the end."""
    out = []
    for c in text.lower() + "\n":
        out += list(c.encode()) if c.isalpha() else [0] * len(c.encode())
    return out


def grams_of(text):
    out, b = [], bytes_of(text)
    for i in range(len(b)):
        own = [b[i]]
        for k in range(1, toxicity.ORDER):
            x = b[i - k] if i >= k and (k == 1 or own[0]) else 0
            own.insert(0, x)
        if any(own):
            out.append(tuple(own))
    return out


def kneser_ney(counts):
    """Probability of an n-gram of the longest order, straight from the definition."""
    levels = [counts]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(collections.Counter(g[1:] for g in levels[-1]))

    def p(level, g):
        if level == len(levels):
            return 1 / 256
        same = [c for x, c in levels[level].items() if x[:-1] == g[:-1]]
        return (max(levels[level][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * p(level + 1, g[1:])) / sum(same)

    return lambda g: p(0, g)


@pytest.mark.parametrize("bits", [1, 3, None])
def test_evidence_equals_the_two_models(spark, bits):
    """However few entries the tasks hold, the evidence is the difference of two Kneser-Ney models' log-likelihoods."""
    taught = [(t, y) for t, y in (("badword baddest bad", 1), ("goodword goodness badge", 0), ("plain words badly ünder", 0), ("zzz", 1), ("words ünd", 1)) for _ in range(7)]
    counts = [collections.Counter(g for t, y in taught if y == label for g in grams_of(t)) for label in (0, 1)]
    shared = kneser_ney(counts[0] + counts[1])
    size = [sum(c.values()) for c in counts]
    weighted = [{g: n * min(size) / size[y] for g, n in counts[y].items()} for y in (0, 1)]

    def q(y, g, only_context=False):
        same = [n for x, n in weighted[y].items() if x[:-1] == g[:-1]]
        back = sum(min(n, toxicity.CLASS_DISCOUNT) for n in same) / sum(same) if same else 1.0
        own = max(weighted[y].get(g, 0) - toxicity.CLASS_DISCOUNT, 0) / sum(same) if same else 0.0
        return back if only_context else own + back * (shared(g) if own else 1)

    def ratio(g):
        """Toxic less ordinary; where neither class has the n-gram above its discount both have the same shared factor."""
        rare = all(weighted[y].get(g, 0) <= toxicity.CLASS_DISCOUNT for y in (0, 1))
        value = [q(y, g, rare) if rare or weighted[y].get(g, 0) > toxicity.CLASS_DISCOUNT else q(y, g) * shared(g) for y in (0, 1)]
        return np.log(value[1] / value[0]), np.log(value[1] / value[0]) - np.log(q(1, g, True) / q(0, g, True))

    entries = toxicity.stored(toxicity.ratios(toxicity.counted(spark.createDataFrame(taught, "text string, toxic int"))), "test-ratios")
    texts = ["badword", "bad goodwill badminton", "unseen wordy plainest zz", "", "badword badword " * 50, "Ünder der ünd", "words" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in toxicity.evidence(docs, toxicity.held(entries, bits), entries, ["id"]).collect()}
    assert len(got) == len(texts) and any(abs(r.total) > 1 for r in got.values())
    for i, text in enumerate(texts):
        each = [ratio(g) for g in grams_of(text)]
        assert got[i].n == len(each)
        assert got[i].total == pytest.approx(sum(x for x, _ in each), abs=1e-9)
        for name, cut in zip(("e0", "e1"), toxicity.CLEAR, strict=True):
            assert got[i][name] == pytest.approx(sum(x for _, x in each if x > cut), abs=1e-9)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_grams_in_blocks(block):
    texts = ["Ab c", "", "zz ab 1 éßü日本 x", "𝔘nicode İstanbul", "a" * 30]
    got = [(k, t) for key, text in toxicity.grams(texts, block) for k, t in zip(key.tolist(), text.tolist(), strict=True)]
    assert got == [(int.from_bytes(bytes(g), "big"), i) for i, t in enumerate(texts) for g in grams_of(t)]
    assert not sum(len(k) for k, _ in toxicity.grams(["", "1 2"], block))


def test_held_out_labels_do_not_matter(spark, docs):
    rows = [(i, f"text {'vile' if i % 3 == 0 else 'kind'} number words {i}") for i in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert any(held(i) for i, _ in rows)
    for known in (range(60), [i for i, _ in rows if held(i)]):
        out = []
        for flip in (0, 1):
            y = spark.createDataFrame([(i, 1, int(i % 3 == 0) ^ (flip if held(i) else 0)) for i in known], "doc_id long, quality int, toxic int")
            out.append(sorted(map(tuple, toxicity.scores(docs(rows), y).collect())))
        assert out[0] == out[1]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    y = spark.read.parquet(f"{sf}/labels.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        steps[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = steps["toxicity"]
    assert ids(after) == ids(before) - ids(toxicity.scores(before, y).filter("predicted = 1"))
    before, after = steps["quality"]
    assert ids(after) == ids(before) - ids(quality.scores(before, y).filter("not keep"))
    before, after = steps["near_duplicates"]
    assert ids(after) == ids(near_dup.classes(before).filter("doc_id = class_id"))
    before, after = steps["substrings"]
    cut = {r.doc_id: r for r in substring.removed(before).collect()}
    whole = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == {i: cut[i].kept if cut[i].n_removed else whole[i] for i in whole}
    before, after = steps["packing"]
    assert after.agg(F.sum("length")).first()[0] == packing.pieces_of(before).agg(F.sum("length")).first()[0]


def test_co_training_round_equals_brute_force(spark):
    """One exchange on a table equals the same on arrays; the step then zeroes the gradient of the weighted examples."""
    rng = np.random.default_rng(4)
    a = np.column_stack([np.ones(400), rng.normal(size=(400, 3))])
    source, language = rng.normal(size=400), rng.normal(size=400)
    y = (a[:60, 1] + (source[:60] > 0) > 0.3).astype(float)
    views = [a, quality.page_view(source, language)]
    weights = [quality.fitted(v[:60], y, quality.RIDGE) for v in views]
    pool = spark.createDataFrame([(x.tolist(), float(s), float(n)) for x, s, n in zip(a[60:], source[60:], language[60:], strict=True)], "a array<double>, source double, language double")
    got = quality.pooled(pool, weights, 0.7)
    after = quality.co_trained([v[:60] for v in views], y, pool, rounds=1, sure=0.7)
    for mine, other in ((0, 1), (1, 0)):
        x, w = views[mine], weights[mine]
        want, gradient, taught = np.zeros((len(w), len(w))), np.zeros(len(w)), 0
        for i in range(60, 400):
            p = 1 / (1 + np.exp(-views[other][i] @ weights[other]))
            if max(p, 1 - p) >= 0.7:
                mean = 1 / (1 + np.exp(-x[i] @ w))
                want += np.outer(x[i], x[i]) * mean * (1 - mean)
                gradient += x[i] * (float(p >= 0.5) - mean)
                taught += 1
        assert taught and got[mine][-1] == taught
        assert np.allclose(got[mine], np.concatenate([want.reshape(-1), gradient, [taught]]), atol=1e-9)
        share = min(1, 60 / taught)
        for i in range(60):
            mean = 1 / (1 + np.exp(-x[i] @ w))
            want = want + np.outer(x[i], x[i]) * mean * (1 - mean) / share
            gradient = gradient + x[i] * (y[i] - mean) / share
        step = np.linalg.solve(want * share + quality.RIDGE * np.eye(len(w)), gradient * share - quality.RIDGE * w)
        assert np.allclose(after[mine], w + step, atol=1e-9)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_words_stand_for_labels_as_counted(spark, bits):
    """However few log-odds the tasks hold, a text's words and pairs count as by plain dictionaries; rare and unclear ones count as zero."""
    rng = np.random.default_rng(8)
    tongue = [[f"{x}{i}" for i in range(4)] for x in ("bad", "good", "any")]
    taught = [(i, " ".join(rng.choice(tongue[y] + tongue[2], 60)), float(y), half) for i, (y, half) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)] * 9)]
    rows = [(i, t, i % 3) for i, t in enumerate([*(t for _, t, _, _ in taught[:8]), "", None, "good1 unseen words good2", "bad3 " * 50])]
    counts = [[collections.Counter() for _ in range(4)] for _ in range(2)]
    parts = lambda t: (lambda w: (w, list(zip(w, w[1:]))))((t or "").split())  # noqa: E731, B905
    for _, text, good, half in taught:
        for c, found in zip(counts, parts(text), strict=True):
            c[half * 2 + int(good)].update(found)

    def value(c, x, half):
        bad, good = (sum((c[2 * h + y] for h in ((1,), (0,), (0, 1))[half]), collections.Counter()) for y in (0, 1))
        usual = (good.total() + quality.ADDED) / (good.total() + bad.total() + 2 * quality.ADDED)
        g, b = good[x] + quality.ADDED * usual, bad[x] + quality.ADDED * (1 - usual)
        out = np.log(g / b) - np.log(usual / (1 - usual))
        return out if sum(k[x] for k in c) >= quality.RARE and abs(out) > quality.CLEAR * np.sqrt(1 / g + 1 / b) else 0.0

    odds = quality.log_odds(quality.word_counts(spark.createDataFrame(taught, "id long, text string, good double, half int")))
    model = quality.held(odds, bits)
    assert (bits == 12) != bool(model.more.any())
    docs = spark.createDataFrame(rows, "id long, text string, half int").withColumn("text", F.coalesce("text", F.lit("")))
    got = {r.id: r.a[-2:] for r in quality.featured(docs, model, odds, ["id"]).collect()}
    for i, text, half in rows:
        want = [2 * np.tanh(sum(value(c, x, half) for x in found) / max(len(found), 1)) for c, found in zip(counts, parts(text), strict=True)]
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert any(abs(x[0]) > 0.5 for x in got.values()) and any(abs(x[1]) > 0.02 for x in got.values())


def test_only_keys_with_an_entry_are_joined(spark):
    """Keys that no entry has aren't looked up in the table, but for a few, however full the slots are; all that aren't held are."""
    entries = spark.range(4000).selectExpr("id * 8 + 3 as key", "id + 1.0d as value", "id as n")
    model = toxicity.held(entries, 3)
    key = np.arange(4000) * 8 + 3
    value, later = model.value(key), np.isin(np.arange(4000), model.later(key))
    assert (value > 0).sum() == 32 and (later == (value == 0)).all()
    assert value[value > 0].tolist() == (key[value > 0] // 8 + 1.0).tolist()
    unseen = np.arange(100_000) * 8 + 5
    assert not model.value(unseen).any() and len(model.later(unseen)) < 10_000


@pytest.mark.parametrize("bits", [1, 12])
def test_copies_of_a_text_have_its_views(spark, bits):
    """Rows beyond what tasks hold are found by text; copies, other halves and long columns beside them change nothing."""
    entries = quality.word_counts(spark.createDataFrame([(i, "good one " * 5 if i % 2 else "bad one " * 5, float(i % 2), i // 2 % 2) for i in range(16)], "id long, text string, good double, half int"))
    odds = quality.log_odds(entries)
    model = quality.held(odds, bits)
    text = ["good one bad", "one bad one", "good one bad"]
    docs = spark.createDataFrame([(i, text[i % 3], i % 3 if i < 9 else 2, "x" * i) for i in range(12)], "id long, text string, half int, keep_0 string")
    got = {r.id: (r.keep_0, [round(x, 9) for x in r.a]) for r in quality.featured(docs, model, odds, ["id", "keep_0"]).collect()}
    alone = {i: [round(x, 9) for x in quality.featured(docs.filter(f"id = {i}"), quality.held(odds, 12), odds, ["id"]).first().a] for i in (0, 1, 9)}
    assert len(got) == 12 and all(got[i][0] == "x" * i for i in got)
    assert all(got[i][1] == alone[0] for i in (0, 3, 6)) and all(got[i][1] == alone[1] for i in (1, 4, 7)) and got[9][1] == got[11][1] == alone[9]


def test_quality_views_and_labels(spark, docs):
    """Held-out labels don't matter, carried columns stay with their row, and n_chars is in no view."""
    rows = [(i, f"fine words of row {i} " * 9 if i % 3 else f"junk### words*** of row {i} " * 9) for i in range(90)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    out = []
    for flip in (0, 1):
        y = spark.createDataFrame([(i, int(i % 3 > 0) ^ (flip if held(i) else 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
        table_ = docs(rows).withColumn("n_chars", F.col("n_chars") * (1 + 1000 * flip))
        got = quality.scores(table_, y, carry=("text", "lang")).collect()
        assert {r.doc_id: r.text for r in got} == dict(rows) and {r.lang for r in got} == {"en"}
        out.append({r.doc_id: r.score for r in got})
    assert out[0] == pytest.approx(out[1], abs=1e-9)
    assert np.mean([(s >= 0.5) == (i % 3 > 0) for i, s in out[0].items()]) > 0.95


def test_the_page_view_teaches_where_metadata_tells(spark, docs):
    """Hundreds of sources, each of one quality: the page view alone rates documents of known sources."""
    rnd = np.random.default_rng(0).integers(0, 300, 3000).tolist()  # not by id: its checksums go with its digits
    rows = [(i, f"same words in every text {i % 7}", f"host-{h}") for i, h in enumerate(rnd)]
    table_ = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame([(i, h % 2, 0) for i, h in enumerate(rnd) if i % 4], "doc_id long, quality int, toxic int")
    got = quality.scores(table_, y).collect()
    assert np.mean([(r.score_page >= 0.5) == bool(rnd[r.doc_id] % 2) for r in got if r.held_out]) > 0.9
    assert np.mean([r.keep == bool(rnd[r.doc_id] % 2) for r in got]) > 0.9


def test_samples_are_the_rows_with_the_smallest_hashes(spark):
    df = spark.range(5000).selectExpr("id", "id % 10 as x")
    want = {r.id for r in df.orderBy(F.xxhash64("id", "x").bitwiseAND(F.lit(0xFFFFFFFF)), "id").limit(300).collect()}
    assert {r.id for r in quality.sampled(df, 300, "id", "x").collect()} == want
    assert quality.sampled(df, 9000, "id", "x").count() == 5000


def test_pipeline_edges(spark, docs, tmp_path):
    """Nulls, repeats and clashing columns pass all stages; an empty table gives no sequences."""
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "lost words"), (None, text), (5, text.replace("w1 ", "x1 ")), (6, "other words here")]
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given, want in ((rows, [(None, "lost words"), (None, text), (1, text), (3, None), (4, ""), (6, "other words here")]), ([], [])):
        table = docs(given, True)
        for name, stage in corpus_pipeline.STAGES:
            table = corpus_pipeline.stored(stage(spark, table, f"file://{tmp_path}"), f"edges-{name}")
            if name == "substrings":
                assert sorted(((r.doc_id, r.text) for r in table.collect()), key=str) == sorted(want, key=str)
        assert sorted((r.doc_id for r in table.collect()), key=str) == sorted((i for i, _ in want), key=str)
