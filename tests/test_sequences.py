"""Brute-force twins of the sequence operators and metrics on random inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import inference, metrics, sampling, sequence


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    rows = [(s, p, int(rng.random() < 0.4), float(np.round(rng.random(), 2))) for s, n in enumerate((1, 2, 7, 31)) for p in range(n)]
    return spark.createDataFrame(rows, "seq_id long, pos int, label int, prob double"), rows


def by_sequence(rows):
    out = {}
    for s, p, y, v in sorted(rows):
        out.setdefault(s, []).append((p, y, v))
    return out


def path(values, stay):
    """Textbook two-state decoder."""
    lo, up = math.log(1 - stay), math.log(stay)
    score, back = None, []
    for v in values:
        q = min(1 - 1e-6, max(1e-6, v))
        emit = (math.log(1 - q), math.log(q))
        if score is None:
            score = [math.log(0.5) + e for e in emit]
            continue
        step, new = [], []
        for s in (0, 1):
            c = [score[r] + (up if r == s else lo) for r in (0, 1)]
            r = int(c[1] > c[0])
            step.append(r)
            new.append(c[r] + emit[s])
        score = new
        back.append(step)
    s = int(score[1] > score[0])
    out = [s]
    for step in reversed(back):
        s = step[s]
        out.append(s)
    return out[::-1]


@pytest.mark.parametrize("stay", [0.7, 0.95])
def test_viterbi(items, stay):
    df, rows = items
    got = {(r.seq_id, r.pos): r.state for r in sequence.viterbi(df, stay).collect()}
    for s, own in by_sequence(rows).items():
        assert [got[s, p] for p, _, _ in own] == path([v for _, _, v in own], stay)


@pytest.mark.parametrize("width", [1, 2, 3, 6, 9])
def test_filters(items, width):
    df, rows = items
    out = sequence.smooth_all(df, [("m", "movavg", width), ("d", "median", width)]).collect()
    got = {(r.seq_id, r.pos): (r.m, r.d) for r in out}
    for s, own in by_sequence(rows).items():
        v = [x for _, _, x in own]
        for i in range(len(v)):
            w = [v[min(len(v) - 1, max(0, j))] for j in range(i - width // 2, i - width // 2 + width)] if width > 1 else [v[i]]
            assert got[s, i] == pytest.approx((np.mean(w), np.median(w)))


def test_ranking_metrics(items):
    df, rows = items
    got = metrics.ranking_metrics(df, []).first()
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pos, neg = p[y == 1], p[y == 0]
    assert got.auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    ap, before = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp = int(((p >= t) & (y == 1)).sum())
        ap += (tp - before) / len(pos) * tp / int((p >= t).sum())
        before = tp
    assert got.auprc == pytest.approx(ap)


def test_threshold_is_the_lowest_of_the_best(items):
    df, rows = items
    got = metrics.pick_threshold(df, [], "f1").first()
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    f1 = [2 * ((p >= k / 100) & (y == 1)).sum() / max(1, (p >= k / 100).sum() + (y == 1).sum()) for k in range(1, 100)]
    assert got.threshold == (int(np.argmax(f1)) + 1) / 100
    assert got.f1 == pytest.approx(max(f1))


def test_windows_cover_every_item(items):
    df, rows = items
    w = sequence.clip_windows(df, 4, 3).collect()
    for s, own in by_sequence(rows).items():
        assert {r.ordinal for r in w if r.seq_id == s} == set(range(len(own)))
    assert all(r.is_pad for r in w if r.seq_id == 0 and r.slot > 0)


def test_draws_do_not_depend_on_partitions(items):
    df, _ = items
    pick = lambda x: sorted(map(tuple, sampling.build_condition(x, sampling.Condition("c", k=5, strategy="random", budget=9, budget_unit="video"), 3).select("seq_id", "pos").collect()))
    assert pick(df.repartition(1)) == pick(df.repartition(17))
    assert len(pick(df)) == 9


def test_sampling_rules(items):
    df, rows = items
    assert sampling.sample_uniform(df, 1).count() == len(by_sequence(rows))
    assert sampling.budget_items(df, 10**6, 1).count() == len(rows)
    with pytest.raises(ValueError, match="no strategy"):
        sampling.sample_per_sequence(df, 3, "nope")


def test_pairs_must_align(items):
    df, _ = items
    with pytest.raises(Exception, match="differ in their items"):
        inference.align_pairs(df, df.filter("pos > 0"), ["seq_id", "pos"]).collect()


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.4)], "seq_id long, pos int, label int, prob double")
    row = metrics.ranking_metrics(df, []).first()
    assert row.auroc is None and row.auprc == 1.0
    m = metrics.confusion_metrics(metrics.confusion_counts(df, F.col("prob") >= 0.5, [])).first()
    assert m.specificity is None and m.mcc == 0.0 and m.precision == 0.0
