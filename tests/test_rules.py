"""Files, reports, errors and models that no SQL states, each against a plain count or a twin in numpy."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.functions import draws
from seqlab.operators import experiments, inference, ingest, metrics, model, sampling, splitting
from seqlab.sources import files, shared


def test_lowest_and_ranked_equal_a_sort(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), int(h)) for i, h in enumerate(rng.choice([7, 8, 1 << 31, *rng.integers(0, 1 << 32, 40)], 300))]
    df = spark.createDataFrame(rows, "id long, k int, h long")
    want = sorted(rows, key=lambda r: (r[2], r[0]))
    for n in (0, 1, 37, 299, 300, 999):
        assert sorted(r.id for r in draws.lowest(df, n, "h", ["id"]).collect()) == sorted(r[0] for r in want[:n])
    got = {r.id: r.rank for r in draws.ranked(df, "h", ["id"], ["k"]).collect()}
    for k in range(3):
        assert [got[r[0]] for r in want if r[1] == k] == list(range(sum(r[1] == k for r in rows)))
    by_k = draws.lowest(df, 20, "h", ["id"], ["k"]).collect()
    assert sorted(r.id for r in by_k) == sorted(r[0] for k in range(3) for r in [x for x in want if x[1] == k][:20])


def test_bootstrap_of_ranking_metrics(spark):
    """Every replicate's AUROC and average precision from the rows themselves."""
    rng = np.random.default_rng(6)
    rows = [(s, p, int(rng.random() < 0.4), float(np.round(rng.random(), 1))) for s in range(6) for p in range(int(rng.integers(1, 7)))]
    df = spark.createDataFrame(rows, "seq_id long, pos int, label int, prob double")
    got = {r.rep: r for r in inference.ranking_replicates(df, 25, 11, []).collect()}
    used = []
    for rep in range(25):
        own = [int(hashlib.md5(f"11|boot|{rep}|{slot}".encode()).hexdigest()[:8], 16) % 6 for slot in range(6)]
        y, p = (np.array([r[c] for s in own for r in rows if r[0] == s]) for c in (2, 3))
        pos, neg = p[y == 1], p[y == 0]
        assert (got[rep].pos, got[rep].n) == (len(pos), len(y))
        if len(pos) and len(neg):
            used.append(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
            assert got[rep].auroc == pytest.approx(used[-1])
            steps = [(((p >= t) & (y == 1)).sum(), ((p == t) & (y == 1)).sum(), (p >= t).sum()) for t in set(p)]
            assert got[rep].auprc == pytest.approx(sum(k / len(pos) * hit / all_ for hit, k, all_ in steps))
    ci = inference.bootstrap_ci(df, F.lit(0.5), "auroc", 25, 11).first()
    assert (ci.low, ci.high, ci.n_used) == (pytest.approx(np.quantile(used, 0.025)), pytest.approx(np.quantile(used, 0.975)), len(used))


def test_fit_score_and_grid(spark):
    """The model is the minimum of the weighted, penalised log-loss; its threshold is chosen on validation alone."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.7 * rng.normal(size=240) > 0.8).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id int, features array<double>, label int")
    train, val, test = df.filter("id < 120"), df.filter("id >= 120 and id < 180"), df.filter("id >= 180")
    got = {r.id: r for r in model.fit_score(train, val, test).collect()}
    a, t = x[:120], y[:120]
    weight = np.where(t == 1, 120 / (2 * t.sum()), 120 / (2 * (120 - t.sum())))
    scale = np.sqrt(np.average((a - np.average(a, axis=0, weights=weight)) ** 2, axis=0, weights=weight) * 120 / 119)
    z, w = np.column_stack([a, np.ones(120)]), np.zeros(4)
    ridge = np.append(0.01 * scale**2, 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + np.diag(ridge), z.T @ (weight * (p - t)) / weight.sum() + ridge * w)
    want = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert max(abs(got[i].prob - want[i]) for i in range(180, 240)) < 0.02
    f1 = []
    for k in range(1, 100):
        guess, own = want[120:180] >= k / 100, y[120:180] == 1
        f1.append(np.mean([2 * (guess & own).sum() / max(1, guess.sum() + own.sum()), 2 * (~guess & ~own).sum() / max(1, (~guess).sum() + (~own).sum())]))
    best = {(k + 1) / 100 for k in range(99) if f1[k] > max(f1) - 0.03}
    cut = [min((r.prob for r in got.values() if r.predicted), default=1), max((r.prob for r in got.values() if not r.predicted), default=0)]
    assert any(cut[1] < b <= cut[0] for b in best)
    build = lambda c, seed: train.filter(f"id % 3 <> {seed}") if c == "part" else train
    grid = model.run_grid([("part", 0), ("part", 1), ("all", 0)], build, val, test).collect()
    assert len(grid) == 180
    assert {r.id: r.prob for r in grid if (r.condition, r.seed) == ("all", 0)} == pytest.approx({i: r.prob for i, r in got.items()})


def test_predictions_splits_and_manifest_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("r1", "a", 0, 1, 0.25, 9), ("r1", "a", 1, 0, 0.5, 9), ("r2", "b", 0, 1, None, 9)], "run string, seq_id string, pos int, label int, prob double, extra int")
    files.write_predictions(p, f"file://{tmp_path}/p")
    got = files.read_predictions(spark, f"file://{tmp_path}/p")
    assert sorted(map(str, got.select("run", "seq_id", "pos", "label", "prob").collect())) == sorted(map(str, p.drop("extra").collect()))
    splits = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "seq_id string, split string")
    items = spark.createDataFrame([("a", 0, 1, "train"), ("a", 1, 0, "train"), ("b", 0, 0, "val"), ("c", 0, 1, "test")], "seq_id string, pos int, label int, orig_split string")
    files.write_splits(splits, f"file://{tmp_path}/s", "official", 3, splitting.split_profile(items, splits, totals=False))
    assert sorted(map(tuple, files.read_splits(spark, f"file://{tmp_path}/s").collect())) == sorted(map(tuple, splits.collect()))
    notes = {r.split: r for r in files.read_diagnostics(spark, f"file://{tmp_path}/s").collect()}
    assert set(notes) == {"train", "val", "test"} and notes["train"].rows == 2 and notes["val"].scheme == "official" and notes["val"].seed == 3
    m = spark.createDataFrame([("v1", "x, y", "train", 'a "b"', 12), ("v2", None, "test", "c", 0)], "video_id string, stem string, split string, source string, n_frames long")
    files.write_manifest(m, f"file://{tmp_path}/m")
    assert sorted(map(str, files.read_manifest(spark, f"file://{tmp_path}/m").collect())) == sorted(map(str, m.collect()))
    m.withColumn("n_frames", F.lit("many")).write.option("header", "true").csv(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="lacks an id or a count"):
        files.read_manifest(spark, f"file://{tmp_path}/bad").collect()
    files.write_report(splits, f"file://{tmp_path}/r", "csv")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/r").count() == 3


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "gb18030", "cp1252", "latin-1"])
def test_encoding_of_the_whole_file(spark, tmp_path, name):
    """What tells stands behind the first MiB."""
    tail = {"utf-8": "é", "utf-8-sig": "é", "gb18030": "视频", "cp1252": "“x” é", "latin-1": "x\x81 é\x8d "}[name]
    raw = ("filename,label\n" + "a,1\n" * 300_000 + tail + ",1\n").encode(name)
    (tmp_path / "l.csv").write_bytes(raw)
    found = files.detect_encoding(spark, f"file://{tmp_path}/l.csv")
    first = "utf-8-sig" if name == "utf-8-sig" else next(n for n, _ in files.ENCODINGS if n != "utf-8-sig" and _fits(raw, n))
    assert found == first


def _fits(raw, name):
    try:
        return raw.decode(name) is not None
    except UnicodeDecodeError:
        return False


def test_conditions_from_a_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"name": "sparse", "k": 5}, {"name": "dense", "budget": 10, "budget_unit": "video", "target_pos_rate": 0.5}]))
    got = files.load_conditions(spark, f"file://{path}")
    assert got == [sampling.Condition("sparse", 5), sampling.Condition("dense", budget=10, budget_unit="video", target_pos_rate=0.5)]
    for bad in ([{"name": "a", "size": 1}], [{"k": 1}], [{"name": "a"}, {"name": "a"}]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ingest.IngestError):
            files.load_conditions(spark, f"file://{path}")


def test_reports_and_errors(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 1)], "seq_id string, pos int, label int")
    r = sampling.budget_report(df, 5, 0.6).first()
    assert (r.rows, r.short, r.off_prior) == (3, True, True)
    r = sampling.budget_report(df, 3, 0.66).first()
    assert (r.short, r.off_prior) == (False, False) and sampling.budget_report(df.filter("pos > 9"), 1).first().short
    codes = spark.createDataFrame([("train", 7, 1)], "split string, code int, class int")
    raw = spark.createDataFrame([("train", 7), ("train", 0), ("val", 7)], "split string, raw int")
    assert sorted((r.split, r.raw, r["class"]) for r in ingest.decode_codes(raw, codes, "split", "raw").collect()) == [("train", 0, 0), ("train", 7, 1), ("val", 7, None)]
    with pytest.raises(Exception, match="unknown code 7 in val"):
        ingest.decode_codes(raw, codes, "split", "raw", strict=True).collect()
    with pytest.raises(Exception, match="fewer than two"):
        sampling.first_last(df, F.col("pos") >= 0, "label", "pos", strict=True).collect()
    got = metrics.pick_threshold(spark.createDataFrame([], "label int, prob double"), []).first()
    assert (got.threshold, got.macro_f1) == (0.5, None)
    metrics.objective("youden", "recall + specificity - 1")
    assert metrics.pick_threshold(spark.createDataFrame([(1, 0.9), (0, 0.4)], "label int, prob double"), [], "youden").first().youden == 1.0


def test_dice_means_reasons_and_acceptance(spark):
    d = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.2), (2, 1, None), (2, 0, 0.7), (2, 2, 0.8)], "g int, klass int, dice double")
    got = {r.klass: (r.dice, r.groups) for r in metrics.dice_means(d, "klass").collect()}
    assert got[0] == (pytest.approx(0.6), 2) and got[1] == (0.2, 1) and got[2] == (0.8, 1) and got[None][0] == pytest.approx(0.5)
    v = spark.createDataFrame([("k", 1.0, "ok"), ("k", None, "empty"), ("k", None, "flat"), ("k", None, None)], "key string, v double, why string")
    s = metrics.null_safe_summary(v, ["key"], "v", {"empty": F.col("why") == "empty", "flat": F.col("why") == "flat"}).first()
    assert (s.n, s.n_null, s.n_empty, s.n_flat) == (1, 3, 1, 1)
    arms = spark.createDataFrame([("base", 0.70, 0.6, 0), ("a", 0.72, 0.5, 1), ("b", 0.72, 0.9, 2)], "arm string, val double, test double, ord int")
    yes, no = (experiments.accept_winner(arms, "ord", "base", g).first() for g in (0.01, 0.05))
    assert (yes.arm, yes.accepted, yes.use, yes.use_test) == ("a", True, "a", 0.5)
    assert (no.arm, no.accepted, no.use, no.use_test) == ("a", False, "base", 0.6)


def test_shared_folder_must_be_named_off_one_machine():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.fresh_path(Session, "x")
