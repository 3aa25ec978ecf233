"""Ranges, numbers, quantiles, long sequences and many runs at once against plain forms."""

import hashlib
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from seqlab.operators import experiments, inference, metrics, model, ordering, sampling, sequence


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 16 rows and frames of 32 items, so that little data has many borders."""
    monkeypatch.setattr(ordering, "BLOCK_BITS", 4)
    monkeypatch.setattr(sequence, "FRAME", 32)


@pytest.fixture(scope="module")
def long_items(spark):
    """One sequence with most rows, a few short ones, a null id; positions with gaps."""
    rnd = random.Random(5)
    rows = [(s, 3 * p, int(rnd.random() < 0.3), round(rnd.random(), 3)) for s, n in ((1, 900), (2, 1), (3, 40), (None, 60), (4, 33)) for p in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "seq_id long, pos int, label int, prob double"), rows


def test_numbers_of_any_key(spark, small_blocks):
    rnd = random.Random(0)
    for kind, keys in (("long", [rnd.getrandbits(63) for _ in range(700)]), ("string", [f"sequence-{i:06d}" for i in range(700)]), ("double", [rnd.random() for _ in range(700)])):
        df = spark.createDataFrame([(k, i % 3 or None) for i, k in enumerate(keys)], f"k {kind}, g int")
        assert {r.k: r.number for r in ordering.numbered(df, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}
        got = {(r.g, r.k): r.number for r in ordering.numbered(df, "k", ["g"]).collect()}
        for g in (None, 1, 2):
            own = sorted(k for i, k in enumerate(keys) if (i % 3 or None) == g)
            assert [got[g, k] for k in own] == list(range(len(own)))
    rows = ordering.ranged(df, ["k"])
    assert rows.groupBy("_block").count().agg(F.max("count")).first()[0] <= 16
    assert ordering.numbered(df.filter("false"), "k").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_by_counts(spark, hot):
    rnd = random.Random(1)
    rows = [(g, None if rnd.random() < 0.1 else (0.5 if hot and rnd.random() < 0.6 else rnd.gauss(0, 10 ** rnd.randint(-3, 3)))) for g in ("a", "b", None) for _ in range(rnd.randint(1, 400))]
    df = spark.createDataFrame([*rows, ("c", None), ("d", 4.0)], "g string, v double")
    got = {r.g: r.quantiles for r in ordering.quantiles(df, "v", [0.0, 0.25, 0.5, 0.975], ["g"]).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g in got:
        own = [v for x, v in rows if x == g and v is not None] or [4.0]
        assert got[g] == pytest.approx(np.quantile(own, [0.0, 0.25, 0.5, 0.975]))
    every = [v for _, v in rows if v is not None] + [4.0]
    assert ordering.quantiles(df, "v", [0.5]).first().quantiles == pytest.approx([np.median(every)])
    assert ordering.quantiles(df.filter("false"), "v", [0.5]).first().quantiles is None
    assert ordering.quantiles(df.filter("false"), "v", [0.5], ["g"]).count() == 0


def test_long_sequences_are_what_windows_give(long_items, small_blocks):
    df, rows = long_items
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(sequence.with_ordinal(df, spread=True), sequence.with_ordinal(df))
    assert same(sequence.transitions(df, spread=True), sequence.transitions(df))
    assert same(sequence.runs(df, spread=True), sequence.runs(df))
    got = {(r.seq_id, r.pos): (r.m, r.d) for r in sequence.smooth_all(df, [("m", "movavg", 25), ("d", "median", 6)]).collect()}
    assert len(got) == len(rows)
    for s in {r[0] for r in rows}:
        own = sorted((p, v) for q, p, _, v in rows if q == s)
        v = [x for _, x in own]
        at = lambda i, w: [v[min(len(v) - 1, max(0, j))] for j in range(i - w // 2, i - w // 2 + w)]  # noqa: B023, E731
        for i, (p, _) in enumerate(own):
            assert got[s, p] == pytest.approx((np.mean(at(i, 25)), np.median(at(i, 6))))


def test_walks_over_many_blocks(long_items, small_blocks):
    from test_sequences import path

    df, rows = long_items
    out = sequence.viterbi(df.filter("seq_id is not null"), [0.6, 0.9, 0.99], name=["a", "b", "c"]).collect()
    got = {(r.seq_id, r.pos): (r.a, r.b, r.c) for r in out}
    for s in (1, 2, 3, 4):
        own = sorted((p, v) for q, p, _, v in rows if q == s)
        want = [path([v for _, v in own], stay) for stay in (0.6, 0.9, 0.99)]
        assert [got[s, p] for p, _ in own] == list(zip(*want, strict=True))
    assert sequence.viterbi(df.filter("false"), 0.9).count() == 0


def test_one_sequence_of_many_rows(spark):
    """200,000 rows of one sequence: blocks of 65,536 rows, as large as they come, and a walk by steps."""
    n, limit = 200_000, math.log(0.95 / 0.05)
    df = spark.range(n).selectExpr("7 as seq_id", "id as pos", "(hash(id) & 1023) / 1024.0D as prob")
    rows = df.orderBy("pos").collect()
    want, d, known = [], 0.0, []
    for r in rows:
        q = min(1 - 1e-6, max(1e-6, r.prob))
        d = max(-limit, min(limit, d)) + math.log(q / (1 - q))
        known.append(1 if d > limit else 0 if d <= -limit else None)
    known[-1] = int(d > 0)
    state = None
    for k in reversed(known):
        state = state if k is None else k
        want.append(state)
    got = sequence.viterbi(df, 0.95)
    assert [r.state for r in got.orderBy("pos").collect()] == want[::-1]
    assert ordering.ranged(df, ["seq_id", "pos"]).groupBy("_block").count().agg(F.max("count")).first()[0] <= 1 << 16


def test_sessions_on_one_time_line(spark, small_blocks):
    rnd = random.Random(3)
    at, rows = datetime.datetime(2024, 1, 1), []
    for i in range(500):
        at += datetime.timedelta(minutes=rnd.choice([0, 1, 9, 10, 25]), microseconds=rnd.choice([0, -1]) if i else 0)
        rows.append((i, at, f"20210101000000000000I{i % 6}" if i % 5 == 0 else f"24{i}"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, seq_id string")
    want, k, before = {}, 0, None
    for i, t, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        k += before is not None and (t - before).total_seconds() >= 600
        want[i], before = k, t
    assert {r.event_id: r.session for r in sequence.session_ids(df, 600, []).collect()} == want
    exams = {r.event_id: r.exam for r in sequence.exam_ids(df, 600, F.col("seq_id").startswith("24")).collect()}
    k, before = 0, None
    for i, t, name in sorted(rows, key=lambda r: (r[1], r[0])):
        if not name.startswith("24"):
            assert exams[i] == "20210101000000000000"
            continue
        k += before is None or (t - before).total_seconds() >= 600
        assert exams[i] == f"session{k}"
        before = t


def test_even_rows_by_place(spark, small_blocks):
    for n, k in ((1, 1), (1, 5), (7, 7), (7, 20), (100, 3), (1000, 37)):
        df = spark.range(n).selectExpr("id % 3 as seq_id", "id as pos", "'x' as extra")
        order = sorted((i % 3, i) for i in range(n))
        want = sorted({order[int(i * (n - 1) / max(k - 1, 1))] for i in range(k)})
        assert sorted((r.seq_id, r.pos) for r in sampling.even_rows(df, k).collect()) == want


@pytest.mark.parametrize("metric", ["auroc", "auprc"])
def test_ranking_replicates(spark, metric, monkeypatch):
    monkeypatch.setattr(inference, "ITEMS", 7)
    rnd = random.Random(8)
    rows = [(g, f"c{rnd.randrange(12)}", rnd.randrange(2), rnd.choice([0.1, 0.5, 0.5, round(rnd.random(), 2)])) for g in ("u", "v") for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, seq_id string, label int, prob double")
    got = {(r.g, r.rep): r[metric] for r in inference.ranking_replicates(df, 20, 3, ["g"]).collect()}
    assert len(got) == 40
    numbers = {(r.g, r.seq_id): r.number for r in ordering.numbered(df.select("g", "seq_id").distinct(), "seq_id", ["g"]).collect()}
    times = {}
    sizes = spark.createDataFrame([(g, max(n for (h, _), n in numbers.items() if h == g) + 1) for g in "uv"], "g string, _m long")
    for r in inference.drawn(sizes, 20, 3, ["g"]).collect():
        times[r.g, r.rep, r._i] = times.get((r.g, r.rep, r._i), 0) + 1
    for (g, rep), value in got.items():
        own = [(p, y) for h, c, y, p in rows if h == g for _ in range(times.get((g, rep, numbers[g, c]), 0))]
        plain = metrics.ranking_metrics(spark.createDataFrame(own, "prob double, label int"), []).first() if rep < 3 else None
        if plain:
            assert value == pytest.approx(plain[metric])
    coarse = inference.ranking_replicates(df, 5, 3, [], bins=10).collect()
    assert len(coarse) == 5 and all(0 <= r.auroc <= 1 for r in coarse)


def grid_inputs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5)) * [1, 2, 0.1, 5, 1]
    y = (x @ [1, -0.5, 3, 0.1, 0] + rng.normal(size=600) > 0.3).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int")
    return df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), df.filter("id % 3 = 2")


def test_runs_fitted_together_are_runs_fitted_alone(spark):
    train, val, test = grid_inputs(spark)
    build = lambda c, seed: train.filter(F.col("id") % 7 > (4 if c == "sparse" else 0) - seed)
    got = model.run_grid([(c, s) for c in ("sparse", "dense") for s in (0, 1)], build, val, test)
    for c in ("sparse", "dense"):
        for seed in (0, 1):
            own = {r.id: (r.prob, r.predicted) for r in got.filter((F.col("condition") == c) & (F.col("seed") == seed)).collect()}
            alone = {r.id: (r.prob, r.predicted) for r in model.fit_score(build(c, seed), val, test).collect()}
            assert {k: v[0] for k, v in own.items()} == pytest.approx({k: v[0] for k, v in alone.items()}) and all(own[k][1] == alone[k][1] for k in own)
            # the same model by the library's own optimiser
            w = metrics.class_weights(build(c, seed)).first()
            data = build(c, seed).select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"), F.when(F.col("label") == 1, w["w1"]).otherwise(w["w0"]).alias("w"))
            other = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=100, regParam=0.01, tol=1e-9).fit(data)
            theirs = other.transform(test.withColumn("x", array_to_vector("features"))).select("id", vector_to_array("probability")[1].alias("prob")).collect()
            assert {k: v[0] for k, v in own.items()} == pytest.approx({r.id: r.prob for r in theirs}, abs=2e-3)


def test_a_grid_goes_on_where_it_stopped(spark):
    train, val, test = grid_inputs(spark)
    built = []

    def build(c, seed):
        built.append((c, seed))
        return train.filter(F.col("id") % 5 != seed)

    first = model.run_grid([("a", 0), ("a", 1)], build, val, test)
    marked = first.withColumn("prob", F.lit(0.25))
    second = model.run_grid([(c, s) for c in "ab" for s in (0, 1)], build, val, test, finished=marked)
    assert sorted(built) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert second.filter("prob = 0.25").count() == first.count() == second.filter("condition = 'b'").count()
    assert model.run_grid([("a", 0), ("a", 1)], build, val, test, finished=marked).count() == first.count()
    assert len(built) == 4


def test_named_plans_pairs_and_ensembles(spark):
    done = spark.createDataFrame([("sparse_k1", 0)], "condition string, seed int")
    assert experiments.planned(spark, "arm1", [0, 1, 2], done).count() == 13 * 3 - 1
    with pytest.raises(ValueError, match="plan is one of"):
        experiments.planned(spark, "nope", [0], done)
    runs = spark.createDataFrame([(c, s, v) for c, vs in (("sparse_k5", [0.5, 0.6]), ("dense_matched_k5", [0.4, 0.7, 0.9])) for s, v in enumerate(vs)], "condition string, seed int, f double")
    row = experiments.pair_deltas(runs, "f").first()
    assert (row.dense_name, row.n, row.wins, row.losses) == ("dense_matched_k5", 2, 1, 1) and row["mean"] == pytest.approx(0.0)
    arms = spark.createDataFrame([(f"base_s{k}", 1) for k in range(3)] + [("native256_s0", 1)], "arm string, item int")
    assert {r.ensemble for r in experiments.ensemble_members(arms).collect()} == {"ens_seeds"}
    a = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.5), (4, None)], "k int, prob double")
    b = spark.createDataFrame([(1, 0.2), (2, 0.2), (3, 0.7), (5, 0.1)], "k int, prob double")
    assert [r.k for r in experiments.decisions(a, b, ["k"], 0.5, 0.7).filter("disagree").collect()] == [1]
    tied = spark.createDataFrame([("base", 0, 0.5, 0.4), ("new", 1, 0.5, 0.9)], "arm string, o int, val double, test double")
    row = experiments.accept_winner(tied, "o", "base", 0.0).first()
    assert (row.accepted, row.use) == (False, "base")


def test_replicates_are_not_broadcast(spark):
    """Draws are many times the clusters: with a bound on what may be broadcast both bootstraps still end, and sums are those of the draws. The blocks of a draw are several."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 'u', 'v') as g", "id as seq_id", "id * id % 17 as tp", "cast(1 as long) as n")
    items = rows.selectExpr("g", "seq_id", "cast(tp % 2 as int) as label", "tp / 17 as prob")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    try:
        got = {(r.g, r.rep): (r.tp, r.n) for r in inference.replicates(rows, 200, 5, ["g"], ["tp", "n"], "seq_id").collect()}
        ranking = {(r.g, r.rep): r.n for r in inference.ranking_replicates(items, 200, 5, ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    own = {g: [i * i % 17 for i in range(6000) if (i % 3 == 0) == (g == "u")] for g in "uv"}
    assert len(got) == 400 and {k: n for k, (_, n) in got.items()} == ranking
    for g, rep in (("u", 0), ("v", 0), ("v", 199)):
        m = len(own[g])
        at = [int(hashlib.md5(f"5|boot|{rep}|{slot}".encode()).hexdigest()[:8], 16) % m for slot in range(m)]
        assert got[g, rep] == (sum(own[g][i] for i in at), m)


def test_replicates_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(inference, "HELD", 64)
    monkeypatch.setattr(inference, "STRETCH", 7)
    rows = spark.range(50).selectExpr("id as seq_id", "id as x", "id / 4 as y")
    for r in inference.replicates(rows, 10, 5, [], ["x", "y"], "seq_id").collect():
        at = [int(hashlib.md5(f"5|boot|{r.rep}|{slot}".encode()).hexdigest()[:8], 16) % 50 for slot in range(50)]
        assert (r.x, r.y) == (sum(at), sum(at) / 4)
