"""Streams in any order against their batch form, and the time to live of their state."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from seqlab.functions import walks
from seqlab.functions.columns import clip_logit
from seqlab.operators import sequence
from seqlab.streaming import causal

START = datetime.datetime(2024, 1, 1)
SCHEMA = "seq_id long, pos long, label int, prob double, ts timestamp"


def items(seed=0):
    rnd = random.Random(seed)
    return [(s, p, rnd.randrange(2), rnd.random(), START + datetime.timedelta(minutes=7 * p + s)) for s, n in enumerate((1, 5, 60, 200)) for p in range(n)]


def streamed(spark, tmp_path, batches, operator, name, late="30 days", **more):
    """Runs the operator over the batches, one micro-batch each, with a last row that lets all come out."""
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source).withColumn("logit", clip_logit(F.col("prob")))
    out = None
    for batch in [*batches, [(-1, 0, 0, 0.5, START + datetime.timedelta(days=900))]]:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = causal.drained(operator(stream, late=late, **more), name, f"file://{tmp_path}")
    return out


@pytest.mark.parametrize("width", ["1 hour", "5 days"])
def test_shuffled_batches_give_what_the_batch_form_gives(spark, tmp_path, width):
    rows = items()
    mixed = list(rows)
    random.Random(4).shuffle(mixed)
    batches = [mixed[k::5] for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = streamed(spark, tmp_path / "t3", batches, causal.stream_transitions, "t", width=width)
    want = sequence.transitions(df).select("seq_id", "pos", "is_transition")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    limit = math.log(0.9 / 0.1)
    got = {(r.seq_id, r.pos): r.lead for r in streamed(spark, tmp_path / "t4", batches, lambda s, **k: causal.stream_walk(s, limit, **k), "w", width=width).collect()}
    for s in range(4):
        x = 0.0
        for _, p, _, prob, _ in sorted(r for r in rows if r[0] == s):
            x = max(-limit, min(limit, x)) + math.log(prob / (1 - prob))
            assert got[s, p] == pytest.approx(x, abs=1e-9)


class Calls:
    """A handle whose states count their calls."""

    def __init__(self):
        self.n, self.timers, self.kept = 0, set(), {}

    def state(self, name, *_):
        calls, kept = self, self.kept.setdefault(name, {})

        def counted(f):
            def run(*a):
                calls.n += 1
                return f(*a)

            return staticmethod(run)

        return type("State", (), {
            "get": counted(lambda: kept.get(None)), "exists": counted(lambda: None in kept), "update": counted(lambda v: kept.update({None: tuple(v)})), "clear": counted(lambda: kept.clear()),
            "getValue": counted(kept.get), "containsKey": counted(kept.__contains__), "updateValue": counted(lambda k, v: kept.update({k: v})), "removeKey": counted(kept.pop), "iterator": counted(lambda: iter(list(kept.items()))),
        })()

    getValueState = getMapState = state

    def registerTimer(self, ms):
        self.n += 1
        self.timers.add(ms)


def test_a_key_needs_few_calls_to_its_state(monkeypatch):
    """Whatever the number of stretches, a few rows are read and written at once; many rows are kept by stretch, with the same result."""
    import types

    import numpy as np
    import pandas as pd

    outs = []
    for inline in (causal.INLINE if hasattr(causal, "INLINE") else 0, 5, 0):
        monkeypatch.setattr(causal, "INLINE", inline, raising=False)
        handle, p, got = Calls(), causal.Transitions(10, 10_000), []
        p.init(handle)
        at = np.random.default_rng(3).permutation(np.arange(120))
        for k in range(4):
            chunk = at[k::4]
            list(p.handleInputRows((1,), iter([pd.DataFrame({"micros": 1000 * chunk, "pos": chunk, "value": (chunk // 3 % 2).astype(float)})]), None))
        for now in (30, 30, 77, 20_000):
            got += [tuple(r) for out in p.handleExpiredTimer((1,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda n=now: n), None) for r in out[["pos", "out"]].itertuples(index=False)]
        assert [r[0] for r in got] == list(range(120)) and [r[1] for r in got] == [int(i % 3 == 0 and i > 0) for i in range(120)]
        assert not any(handle.kept.values())
        outs.append(handle.n)
    assert outs[0] <= 30 < outs[2]


def test_two_batches_out_of_order(spark, tmp_path):
    """pos 0 and 2 first, then 1 and 3: the labels in order are 0, 1, 1, 0."""
    at = lambda p, y: (1, p, y, 0.5, START + datetime.timedelta(minutes=p))
    got = streamed(spark, tmp_path, [[at(0, 0), at(2, 1)], [at(1, 1), at(3, 0)]], causal.stream_transitions, "t")
    assert sorted((r.pos, r.is_transition) for r in got.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_rows_are_dropped_beyond_the_delay(spark, tmp_path):
    day = lambda p, y, d: (1, p, y, 0.5, START + datetime.timedelta(days=d))
    got = streamed(spark, tmp_path, [[day(0, 0, 0), day(3, 1, 9)], [day(4, 1, 10)], [day(1, 1, 1)]], causal.stream_transitions, "t", late="1 hour")
    assert sorted((r.pos, r.is_transition) for r in got.collect()) == [(0, 0), (3, 1), (4, 0)]


def test_state_of_an_idle_key_is_gone(spark, tmp_path):
    """A sequence that pauses for idle starts anew, and until it goes on there is no state of it."""
    day = lambda s, p, y, d: (s, p, y, 0.5, START + datetime.timedelta(days=d))
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    stream = causal.stream_transitions(spark.readStream.schema(SCHEMA).parquet(source), late="1 hour", idle="10 days")

    def step(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        return causal.drained(stream, "t", f"file://{tmp_path}")

    def kept():
        state = spark.read.format("statestore").option("stateVarName", "last").load(f"file://{tmp_path}/t-state")
        return sorted(r.key.seq_id for r in state.select("key").collect())

    step(day(1, 0, 0, 0), day(1, 1, 1, 1), day(2, 0, 0, 1))
    step(day(2, 1, 0, 3))
    assert kept() == [1, 2]
    step(day(2, 2, 0, 9))
    step(day(2, 3, 1, 12))
    assert kept() == [2]
    step(day(1, 2, 0, 13), day(2, 4, 1, 21), day(3, 0, 0, 25))
    out = step(day(3, 1, 0, 60))
    assert kept() == [3]
    assert sorted((r.seq_id, r.pos, r.is_transition) for r in out.collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0), (2, 3, 1), (2, 4, 0), (3, 0, 0)]


def test_walks_in_blocks_are_the_walk_by_steps():
    rnd = random.Random(1)
    for _ in range(60):
        n, limit = rnd.choice([0, 1, 70, 5000]), int(walks.fixed(rnd.choice([0.1, 2.0, 7.0])))
        z = walks.fixed([rnd.gauss(0, rnd.choice([0.2, 3])) for _ in range(n)])
        fresh = walks.np.array([rnd.random() < 0.01 for _ in range(n)], dtype=bool)
        start, x, want = rnd.randint(-limit, limit), None, []
        x = start
        for k in range(n):
            d = (0 if fresh[k] else x) + int(z[k])
            want.append(d)
            x = max(-limit, min(limit, d))
        got, end = walks.leads(z, fresh, limit, start)
        assert (got.tolist(), end) == (want, x)
        if n:
            assert int(walks.whole(walks.steps(z, fresh, limit)).of(walks.np.array([start]))[0]) == x
