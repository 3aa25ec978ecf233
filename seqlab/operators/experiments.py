"""Many runs side by side. A run is a row with its condition, model, seed, variant and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .inference import bootstrap_ci
from .metrics import confusion_counts, confusion_metrics, ranking_metrics

# Plans of conditions, pairs (dense, sparse) to compare by seed, and ensembles of arms, by name.
PLANS = {
    "arm1": ["sparse_k1", "sparse_k2", "sparse_k5", "sparse_k10", "sparse_k20", "dense_matched_k5", "dense_prior_matched_k5", "dense_matched_k20", "dense_prior_matched_k20", "dense_stride8", "dense_stride4", "dense_stride2", "dense_all"],
    "headline": ["sparse_k1", "sparse_k5", "dense_matched_k5", "dense_prior_matched_k5", "dense_all"],
    "arm2": ["dense_all"],
}
PAIRS = [("dense_matched_k5", "sparse_k5"), ("dense_prior_matched_k5", "sparse_k5")]
ENSEMBLES = {
    "ens_seeds": ["base_s0", "base_s1", "base_s2"],
    "ens_native_sizes": ["native256_s0", "native384_s0", "native512_s0"],
    "ens_best_mixed": ["base_s0", "native512_s0", "resnet34_s0"],
    "ens_native384_seeds": ["native384_s0", "native384_s1", "native384_s2"],
    "ens_native256_seeds": ["native256_s0", "native256_s1", "native256_s2"],
}

METRICS = ["macro_f1", "balanced_accuracy", "f1", "auroc", "auprc"]


def summarise_runs(runs: DataFrame, metrics: list[str] | None = None, keys: tuple[str, ...] = ("condition", "model", "variant", "n_train")) -> DataFrame:
    metrics = metrics or METRICS
    return runs.groupBy(*keys).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev))), F.count("*").alias("runs"))


def seed_summary(runs: DataFrame, metric: str, condition: str = "condition", seed: str = "seed") -> DataFrame:
    """Conditions with several seeds: n, mean, std, min, max, range, the values in seed order, and whether the range is the widest."""
    m = F.col(metric)
    out = runs.groupBy(condition).agg(
        F.countDistinct(seed).alias("n"), F.avg(m).alias("mean"), F.coalesce(F.stddev(m), F.lit(0.0)).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"),
        (F.max(m) - F.min(m)).alias("range"), F.transform(F.array_sort(F.collect_list(F.struct(seed, metric))), lambda s: s[metric]).alias("values"),
    ).filter("n > 1")
    widest = F.broadcast(out.agg(F.max_by(condition, F.struct(F.col("range"), F.col(condition))).alias("_widest")))
    return out.crossJoin(widest).withColumn("widest", F.col(condition) == F.col("_widest")).drop("_widest")


def pair_by_seed(runs: DataFrame, metric: str, dense: str, sparse: str, condition: str = "condition", seed: str = "seed") -> DataFrame:
    side = lambda c, n: runs.filter(F.col(condition) == c).select(seed, F.col(metric).alias(n))
    return side(dense, "dense").join(side(sparse, "sparse"), seed).withColumn("delta", F.col("dense") - F.col("sparse"))


def paired_delta_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.coalesce(F.stddev("delta"), F.lit(0.0)).alias("std"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"))


def pending(conditions: DataFrame, seeds: DataFrame, finished: DataFrame) -> DataFrame:
    """Planned (condition, seed) pairs without a run; both lists are settings, a handful each."""
    return conditions.crossJoin(seeds).join(finished.select("condition", "seed"), ["condition", "seed"], "left_anti")


def planned(spark: SparkSession, plan: str, seeds: list[int], finished: DataFrame) -> DataFrame:
    """Pending (condition, seed) pairs of a plan by name."""
    if plan not in PLANS:
        raise ValueError(f"plan is one of {sorted(PLANS)}")
    return pending(spark.createDataFrame([(c,) for c in PLANS[plan]], "condition string"), spark.createDataFrame([(s,) for s in seeds], "seed int"), finished)


def pair_deltas(runs: DataFrame, metric: str, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(dense, sparse) and paired_delta_summary() of each pair, over the seeds that both have."""
    named = F.broadcast(runs.sparkSession.createDataFrame(pairs or PAIRS, "dense_name string, sparse_name string"))
    side = lambda own, n: runs.join(named, F.col("condition") == F.col(own)).select("dense_name", "sparse_name", "seed", F.col(metric).alias(n))
    both = side("dense_name", "dense").join(side("sparse_name", "sparse"), ["dense_name", "sparse_name", "seed"]).withColumn("delta", F.col("dense") - F.col("sparse"))
    return both.groupBy("dense_name", "sparse_name").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.coalesce(F.stddev("delta"), F.lit(0.0)).alias("std"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"))


def ensemble_members(df: DataFrame, ensembles: dict[str, list[str]] | None = None, arm: str = "arm") -> DataFrame:
    """Rows of the arms once for each ensemble they belong to, with its name; ensembles of which an arm has no rows are left out."""
    listed = [(name, member, len(members)) for name, members in (ensembles or ENSEMBLES).items() for member in members]
    named = F.broadcast(df.sparkSession.createDataFrame(listed, f"ensemble string, {arm} string, _members int"))
    rows = df.join(named, arm)
    whole = rows.groupBy("ensemble", "_members").agg(F.countDistinct(arm).alias("_there")).filter("_there = _members").select("ensemble")
    return rows.drop("_members").join(F.broadcast(whole), "ensemble")  # a row by ensemble


def ordered_lookup(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the fixed display list, with its rank and group."""
    return df.join(order, key).orderBy("rank", key)


def compare_predictions(a: DataFrame, b: DataFrame, keys: list[str], threshold: float, tolerance: float) -> DataFrame:
    both = a.select(*keys, F.col("prob").alias("pa")).join(b.select(*keys, F.col("prob").alias("pb")), keys)
    worst = F.max(F.abs(F.col("pa") - F.col("pb")))
    return both.agg(F.count("*").alias("n"), worst.alias("max_abs_diff"), F.avg(((F.col("pa") >= threshold) == (F.col("pb") >= threshold)).cast("double")).alias("agreement"), (worst <= tolerance).alias("passed"))


def decisions(a: DataFrame, b: DataFrame, keys: list[str], first: float, second: float) -> DataFrame:
    """keys, what each of two stages says of a row at its own threshold, and whether they disagree; a stage without a score says nothing, which is no disagreement."""
    both = a.select(*keys, F.col("prob").alias("_a")).join(b.select(*keys, F.col("prob").alias("_b")), keys, "full_outer")
    said = both.select(*keys, (F.col("_a") >= first).alias("first_says"), (F.col("_b") >= second).alias("second_says"))
    return said.withColumn("disagree", F.coalesce(F.col("first_says") != F.col("second_says"), F.lit(False)))


def selector_quality(arms: DataFrame, arm: str = "arm", val: str = "val", test: str = "test") -> DataFrame:
    """How well a validation score picks: Pearson, rank correlation (ties by name), the picks and the regret; nulls for three arms or fewer."""
    ranks = arms.withColumns({f"r_{c}": F.row_number().over(Window.orderBy(c, arm)).cast("double") for c in (val, test)})
    best = lambda c: F.max_by(F.struct(arm, test), F.struct(F.col(c), F.col(arm)))
    out = ranks.agg(F.count("*").alias("n"), F.corr(val, test).alias("pearson"), F.corr(f"r_{val}", f"r_{test}").alias("spearman"), best(val).alias("_v"), best(test).alias("_t"))
    enough = F.col("n") > 3
    return out.select("n", F.when(enough, F.col("pearson")).alias("pearson"), F.when(enough, F.col("spearman")).alias("spearman"), F.col(f"_v.{arm}").alias("best_on_val"), F.col(f"_t.{arm}").alias("best_on_test"), (F.col(f"_t.{test}") - F.col(f"_v.{test}")).alias("regret"))


def pick_winner(arms: DataFrame, order: str, arm: str = "arm", val: str = "val", test: str = "test", keys: list[str] | None = None) -> DataFrame:
    """The arm with the best validation score, the first in order of equals, and its test score."""
    best = arms.groupBy(*(keys or [])).agg(F.max_by(F.struct(arm, val, test), F.struct(F.col(val), -F.col(order))).alias("b"))
    return best.select(*(keys or []), f"b.{arm}", f"b.{val}", f"b.{test}")


def accept_winner(arms: DataFrame, order: str, base: str, gain: float, arm: str = "arm", val: str = "val", test: str = "test") -> DataFrame:
    """The winner by validation, the base arm's scores, the gain on validation and whether it is above the least gain (0: any gain, but a tie is none); the arm to use is the base where it doesn't."""
    best = pick_winner(arms, order, arm, val, test)
    own = arms.filter(F.col(arm) == base).select(F.col(val).alias("base_val"), F.col(test).alias("base_test"))
    both = best.crossJoin(own).withColumn("gain", F.col(val) - F.col("base_val")).withColumn("accepted", F.col("gain") > gain)
    return both.select("*", F.when(F.col("accepted"), F.col(arm)).otherwise(F.lit(base)).alias("use"), F.when(F.col("accepted"), F.col(test)).otherwise(F.col("base_test")).alias("use_test"))


def seed_spread(runs: DataFrame, metric: str, base: str, condition: str = "condition") -> DataFrame:
    """Each condition against the base: difference of means, Welch's t, and whether it exceeds the base's range."""
    s = runs.groupBy(condition).agg(F.avg(metric).alias("mean"), F.stddev(metric).alias("std"), F.count("*").alias("n"), (F.max(metric) - F.min(metric)).alias("range"))
    b = F.broadcast(s.filter(F.col(condition) == base).select(*(F.col(c).alias(f"base_{c}") for c in ("mean", "std", "n", "range"))))
    error: Column = F.sqrt(F.col("std") ** 2 / F.col("n") + F.col("base_std") ** 2 / F.col("base_n"))
    diff = F.col("mean") - F.col("base_mean")
    return s.filter(F.col(condition) != base).crossJoin(b).select(condition, "mean", "std", "n", diff.alias("diff"), F.when(error > 0, diff / error).alias("t"), (F.abs(diff) > F.col("base_range")).alias("resolved"))


def group_scores(df: DataFrame, threshold: Column, keys: list[str], metric: str, n_boot: int, seed: int, cluster: str = "seq_id", exam: str | None = None) -> DataFrame:
    """keys (run and group), item and ranking metrics, how many clusters and examinations there are, and the metric's interval (low, high).

    Replicates draw examinations where there are any: the items of one share a patient, a session and a machine, so drawing clusters alone makes the interval too narrow.
    """
    unit = exam or cluster
    counts = [F.countDistinct(cluster).alias("clusters"), *([F.countDistinct(exam).alias("exams")] if exam else [])]
    out = confusion_metrics(confusion_counts(df, F.col("prob") >= threshold, keys)).join(ranking_metrics(df, keys), keys).join(df.groupBy(*keys).agg(*counts), keys)
    return out.join(bootstrap_ci(df, threshold, metric, n_boot, seed, keys, unit).drop("n_used"), keys, "left")


def group_gap(scores: DataFrame, run: str, group: str, metric: str, first: str, second: str) -> DataFrame:
    """Over runs: mean, median, least and greatest of (second - first) and in how many it is positive."""
    wide = scores.groupBy(run).pivot(group, [first, second]).agg(F.first(metric))
    d = wide.select((F.col(f"`{second}`") - F.col(f"`{first}`")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.median("d").alias("median"), F.min("d").alias("min"), F.max("d").alias("max"), F.count_if(F.col("d") > 0).alias("positive"), F.count("d").alias("n"))
