"""The model step: a class-weighted logistic model, a threshold chosen on validation and frozen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored
from .experiments import pending
from .metrics import pick_threshold


#: Newton steps at most, and the largest change of a coefficient that ends them.
STEPS, SETTLED = 30, 1e-7
#: Rows that a task has as arrays at one time.
ROWS = 8192


def _matrix(batch: pa.RecordBatch, features: str) -> np.ndarray:
    lists = batch.column(features)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _sums(rows: DataFrame, run: str, features: str, parts: dict[str, Callable]) -> dict[int, dict[str, np.ndarray]]:
    """By run, sums over rows of each part (x, y, run number -> vector), added up in tasks before they meet; one short vector a run comes to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                own = batch.slice(low, ROWS)
                x, y, r = _matrix(own, features), own.column("y").to_numpy(), own.column(run).to_numpy()
                for k in np.unique(r).tolist():
                    at = r == k
                    got = [f(x[at], y[at], k) for f in parts.values()]
                    out[k] = [a + b for a, b in zip(out[k], got, strict=True)] if k in out else got
        for k, v in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.concatenate([p.ravel() for p in v]).tolist()], pa.list_(pa.float64())), pa.array([[p.size for p in v]], pa.list_(pa.int32()))], names=[run, "v", "sizes"])

    def add(own: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in own.column("v").to_pylist()], axis=0)
        return pa.table([own.column(run).slice(0, 1), pa.array([total.tolist()], pa.list_(pa.float64())), own.column("sizes").slice(0, 1)], names=[run, "v", "sizes"])

    fields = f"{run} int, v array<double>, sizes array<int>"
    found = rows.mapInArrow(partial, fields).groupBy(run).applyInArrow(add, fields).collect()
    return {r[run]: dict(zip(parts, np.split(np.array(r["v"]), np.cumsum(r["sizes"])[:-1]), strict=True)) for r in found}


def fit_runs(rows: DataFrame, runs: int, features: str = "features", label: str = "label", penalty: float = 0.01) -> np.ndarray:
    """(runs, features + 1) coefficients, the constant last, of a class-weighted logistic model for each run of rows (_run from 0, features, label).

    Newton's method on all runs at once: a step is one scan, in which each task adds up every run's gradient
    and curvature. Features are scaled to unit deviation by run, and the penalty is on scaled coefficients
    (half its square sum). Rows with null features or label take no part. A run of one class has the
    constant that the penalty leaves; one without rows has zeros.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(features).isNotNull()).select("_run", F.col(features).cast("array<double>").alias(features), F.col(label).cast("double").alias("y"))
    first = _sums(rows, "_run", features, {"n": lambda x, y, k: np.array([len(y), y.sum()])})
    width = next((len(r[features]) for r in rows.limit(1).collect()), 0)
    weights = {k: np.array([v["n"][0] / (2 * max(v["n"][0] - v["n"][1], 1)), v["n"][0] / (2 * max(v["n"][1], 1))]) for k, v in first.items()}
    of = lambda y, k: np.where(y == 1, weights[k][1], weights[k][0])
    moments = _sums(rows, "_run", features, {"w": lambda x, y, k: np.array([of(y, k).sum(), (of(y, k) ** 2).sum()]), "x": lambda x, y, k: of(y, k) @ x, "xx": lambda x, y, k: of(y, k) @ (x * x)})
    scale, total = {}, {}
    for k, m in moments.items():
        w, w2 = m["w"]
        var = (m["xx"] - m["x"] ** 2 / w) / max(w - w2 / w, 1e-12)
        scale[k] = np.where(var > 1e-12, 1 / np.sqrt(np.maximum(var, 1e-12)), 0.0)
        total[k] = w
    beta = {k: np.zeros(width + 1) for k in moments}
    live = set(beta)
    for _ in range(STEPS):
        if not live:
            break
        now = {k: beta[k] for k in live}

        def design(x: np.ndarray, k: int) -> np.ndarray:
            return np.hstack([x * scale[k], np.ones((len(x), 1))])

        def risk(x: np.ndarray, y: np.ndarray, k: int, now: dict = now) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(design(x, k) @ now[k], -40, 40)))

        def gradient(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
            return (of(y, k) * (risk(x, y, k) - y)) @ design(x, k)

        def curvature(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
            p, d = risk(x, y, k), design(x, k)
            return d.T @ (d * (of(y, k) * p * (1 - p))[:, None])

        got = _sums(rows.filter(F.col("_run").isin(sorted(live))), "_run", features, {"g": gradient, "h": curvature})
        for k, v in got.items():
            ridge = np.append(np.full(width, penalty), 1e-9)
            step = np.linalg.solve(v["h"].reshape(width + 1, -1) / total[k] + np.diag(ridge), v["g"] / total[k] + ridge * beta[k])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))  # a far step is cut
            beta[k] = beta[k] - step
            if np.abs(step).max() < SETTLED:
                live.discard(k)
    out = np.zeros((runs, width + 1))
    for k, b in beta.items():
        out[k] = b * np.append(scale[k], 1.0)
    return out


def scored_by(df: DataFrame, coefficients: np.ndarray, features: str = "features") -> DataFrame:
    """df once for each run, with _run and prob; null features have a null prob."""
    schema = T.StructType([*df.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField("prob", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(features)
            there = pc.is_valid(lists)
            x = lists.filter(there)
            x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) if len(x) else np.zeros((0, coefficients.shape[1] - 1))
            at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            for k, b in enumerate(coefficients):
                prob, null = np.zeros(len(batch)), np.ones(len(batch), bool)
                prob[at], null[at] = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -700, 700))), False
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), k), pa.int32()), pa.array(prob, mask=null)], names=[*batch.schema.names, "_run", "prob"])

    return df.mapInArrow(score, schema)


def fit_score(train: DataFrame, val: DataFrame, test: DataFrame, features: str = "features", label: str = "label", objective: str = "macro_f1") -> DataFrame:
    """test with prob and predicted (at the threshold that val chose): a grid of one run."""
    coefficients = fit_runs(stored(train.select(features, label, F.lit(0).alias("_run")), "grid"), 1, features, label)
    best = pick_threshold(scored_by(val, coefficients, features), [], objective, label=label).first()["threshold"]
    return scored_by(test, coefficients, features).drop("_run").withColumn("predicted", (F.col("prob") >= best).cast("int"))


def run_grid(specs: list[tuple[str, int]], build: Callable[[str, int], DataFrame], val: DataFrame, test: DataFrame, features: str = "features", label: str = "label", finished: DataFrame | None = None) -> DataFrame:
    """Scored test rows of all (condition, seed) runs in one table: the columns of test, prob, predicted, condition and seed.

    finished has such rows of earlier runs: they are kept as they are, and only what pending() finds missing
    is fitted. build(condition, seed) gives a run's training rows. All runs are fitted together, the validation
    rows choose each run's threshold, and the test rows are scored once for all runs.
    """
    spark = test.sparkSession
    if finished is not None:
        one = lambda c, kind: spark.createDataFrame([(x,) for x in sorted({s[c] for s in specs})], kind)
        left = {(r["condition"], r["seed"]) for r in pending(one(0, "condition string"), one(1, "seed int"), finished.select("condition", "seed").distinct()).collect()}
        specs = [s for s in specs if s in left]
        if not specs:
            return finished
    rows = None
    for k, (condition, seed) in enumerate(specs):
        one = build(condition, seed).select(features, label, F.lit(k).alias("_run"))
        rows = one if rows is None else rows.unionByName(one)
    coefficients = fit_runs(stored(rows, "grid"), len(specs), features, label)
    chosen = stored(pick_threshold(scored_by(val, coefficients, features), ["_run"], label=label).select("_run", "threshold"), "thresholds")  # a row by run
    names = spark.createDataFrame([(k, c, s) for k, (c, s) in enumerate(specs)], "_run int, condition string, seed int").join(chosen, "_run", "left")
    out = scored_by(test, coefficients, features).join(F.broadcast(names), "_run").withColumn("predicted", (F.col("prob") >= F.coalesce("threshold", F.lit(0.5))).cast("int"))
    out = out.select(*test.columns, "prob", "predicted", "condition", "seed")
    return out if finished is None else finished.select(out.columns).unionByName(out)
