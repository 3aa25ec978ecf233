"""Scores of predictions: by item, by sequence, by threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import running_total
from .ordering import by_keys, quantiles


def share(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def confusion_counts(df: DataFrame, predicted: Column, keys: list[str], label: str = "label") -> DataFrame:
    hit = lambda y, p: F.sum(((F.col(label) == y) & (predicted == p)).cast("long"))
    return df.groupBy(*keys).agg(hit(1, True).alias("tp"), hit(0, True).alias("fp"), hit(1, False).alias("fn"), hit(0, False).alias("tn"))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Adds the metrics of tp, fp, fn, tn. Averages are over the classes that are there; empty ratios are 0, specificity without negatives null."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = share(2 * tp, 2 * tp + fp + fn), share(2 * tn, 2 * tn + fp + fn)
    has1, has0 = tp + fp + fn > 0, tn + fp + fn > 0
    recall, specificity = share(tp, tp + fn), share(tn, tn + fp, None)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    present = lambda a, in_a, b, in_b: (F.when(in_a, a).otherwise(0.0) + F.when(in_b, b).otherwise(0.0)) / F.greatest(in_a.cast("int") + in_b.cast("int"), F.lit(1))
    n = tp + fp + fn + tn
    return counts.select(
        "*", n.cast("long").alias("n"), share(tp, tp + fp).alias("precision"), recall.alias("recall"), f1.alias("f1"),
        present(f1, has1, f0, has0).alias("macro_f1"), present(recall, tp + fn > 0, F.coalesce(specificity, F.lit(0.0)), tn + fp > 0).alias("balanced_accuracy"),
        F.when(spread > 0, (tp * tn - fp * fn) / spread).otherwise(0.0).alias("mcc"), share(tp + tn, n).alias("accuracy"), specificity.alias("specificity"), share(tp + fn, n).alias("prevalence"),
    )


def ranked_histogram(df: DataFrame, keys: list[str], label: str = "label", prob: str = "prob", buckets: int = 1024) -> DataFrame:
    """Distinct scores from the highest: keys, pos, neg, cum_pos, cum_neg (including the score itself)."""
    bins = df.groupBy(*keys, F.col(prob).alias("_p")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    bins = bins.withColumn("_down", -F.floor(F.col("_p") * buckets)).withColumn("_minus", -F.col("_p"))
    out = running_total(bins, "pos", "_down", [F.col("_minus")], keys, "cum_pos")
    return running_total(out, "neg", "_down", [F.col("_minus")], keys, "cum_neg")


def ranking_metrics(df: DataFrame, keys: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """keys, auroc (ties count half) and auprc (average precision, ties as one step); null for one class, auprc null without positives."""
    h = ranked_histogram(df, keys, label, prob)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + 0.5 * F.col("pos")))
    steps = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    p, n = F.sum("pos"), F.sum("neg")
    return h.groupBy(*keys).agg(F.when((p > 0) & (n > 0), area / (p * n)).alias("auroc"), F.when(p > 0, steps / p).alias("auprc"))


def sequence_metrics(df: DataFrame, threshold: Column, keys: list[str], seq: str = "seq_id") -> DataFrame:
    """Top-1 precision and detection rate over sequences with a positive, false alarm rate over the others."""
    best = F.max_by("label", F.struct(F.col("prob"), -F.col("pos")))
    per = df.groupBy(*keys, seq).agg(best.alias("top"), F.max((F.col("prob") >= threshold).cast("int")).alias("fired"), F.max("label").alias("any"))
    some, none = F.col("any") == 1, F.col("any") == 0
    return per.groupBy(*keys).agg(
        F.avg(F.when(some, F.col("top").cast("double"))).alias("top1_precision"), F.avg(F.when(some, F.col("fired").cast("double"))).alias("detection_rate"),
        F.avg(F.when(none, F.col("fired").cast("double"))).alias("false_alarm_rate"), F.sum(some.cast("long")).alias("n_positive"), F.sum(none.cast("long")).alias("n_negative"),
    )


#: Objectives by name: an expression over the columns of confusion_metrics(). objective() adds to them.
OBJECTIVES: dict[str, str] = {"macro_f1": "macro_f1", "balanced_accuracy": "balanced_accuracy", "f1": "f1"}


def objective(name: str, expression: str) -> None:
    """Registers an objective, a SQL expression over the columns of confusion_metrics()."""
    OBJECTIVES[name] = expression


def threshold_curve(df: DataFrame, keys: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """Metrics at every threshold k / 100 for k in 1..99: one histogram of the data, then small sums."""
    guess = F.floor(F.col(prob) * 100)
    exact = F.when(F.col(prob) >= (guess + 1) / F.lit(100.0), guess + 1).when(F.col(prob) >= guess / F.lit(100.0), guess).otherwise(guess - 1)
    bins = df.groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(99), exact)).cast("int").alias("bin")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    totals = bins.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).filter("all_p is not null")  # no rows, no curve
    grid = totals.select(*keys, "all_p", "all_q", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("k"))
    above = bins.filter("bin >= 1").select(*keys, "p", "q", F.explode(F.sequence(F.lit(1), F.col("bin"))).alias("k")).groupBy(*keys, "k").agg(F.sum("p").alias("tp"), F.sum("q").alias("fp"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = grid.join(above, [*keys, "k"], "left").select(*keys, "k", zero(F.col("tp")).alias("tp"), zero(F.col("fp")).alias("fp"), (F.col("all_p") - zero(F.col("tp"))).alias("fn"), (F.col("all_q") - zero(F.col("fp"))).alias("tn"))
    return confusion_metrics(counts)


def pick_threshold(df: DataFrame, keys: list[str], objective: str = "macro_f1", more: dict[str, str] | None = None, label: str = "label") -> DataFrame:
    """keys, threshold and the objective there; the lowest threshold wins ties. Without keys an empty input has the threshold 0.5 and no objective. more: a caller's objectives, as in OBJECTIVES."""
    known = OBJECTIVES | (more or {})
    if objective not in known:
        raise ValueError(f"objective is one of {list(known)}")
    curve = threshold_curve(df, keys, label).withColumn("_value", F.expr(known[objective]))
    best = curve.groupBy(*keys).agg(F.max_by(F.struct("k", "_value"), F.struct(F.col("_value"), -F.col("k"))).alias("b"))
    return best.select(*keys, F.coalesce(F.col("b.k") / 100.0, F.lit(0.5)).alias("threshold"), F.col("b._value").alias(objective))


def evaluate_all(df: DataFrame, threshold: Column, keys: list[str], seq: str = "seq_id") -> DataFrame:
    """Item, ranking and sequence metrics in one row by keys."""
    out = confusion_metrics(confusion_counts(df, F.col("prob") >= threshold, keys)).join(ranking_metrics(df, keys), keys)
    return out.join(sequence_metrics(df, threshold, keys, seq), keys)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each class: rows / (2 x rows of the class), 1 for a class without rows."""
    n, n1 = F.count("*"), F.sum((F.col(label) == 1).cast("long"))
    weight = lambda m: F.when(m > 0, n / (2 * m)).otherwise(1.0)
    return df.agg(weight(n - n1).alias("w0"), weight(n1).alias("w1"))


def dice(parts: DataFrame, group: str, klass: str) -> DataFrame:
    """From (group, class, in_pred, in_truth, n): 2 |P and G| / (|P| + |G|) by group and class, null where the class isn't in the truth."""
    both, p, g = F.col("in_pred") & F.col("in_truth"), F.col("in_pred"), F.col("in_truth")
    size = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return parts.groupBy(group, klass).agg(size(both).alias("both"), size(p).alias("n_pred"), size(g).alias("n_truth")).withColumn("dice", F.when(F.col("n_truth") > 0, 2 * F.col("both") / (F.col("n_pred") + F.col("n_truth"))))


def dice_means(scores: DataFrame, klass: str, background: int = 0) -> DataFrame:
    """From dice(): by class the mean over the groups that have it, and as class null the mean of the classes besides the background. Groups may be items, or batches whose parts were pooled."""
    means = scores.groupBy(klass).agg(F.avg("dice").alias("dice"), F.count("dice").alias("groups"))
    front = means.filter(F.col(klass) != background).agg(F.lit(None).cast(scores.schema[klass].dataType).alias(klass), F.avg("dice").alias("dice"), F.sum("groups").alias("groups"))
    return means.unionByName(front)


def concentration_ratio(df: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    """Share of the value inside the flagged region over the region's share of the area; null for an empty region or no value."""
    total, inside, n, m = F.sum(value), F.sum(F.when(F.col(flag), F.col(value)).otherwise(0.0)), F.count("*"), F.sum(F.col(flag).cast("long"))
    return df.groupBy(*keys).agg(F.when((total > 0) & (m > 0), (inside / total) / (m / n)).alias("ratio"))


def null_safe_summary(df: DataFrame, keys: list[str], value: str, reasons: dict[str, Column] | None = None) -> DataFrame:
    """Summary of the values that are there, and how many are not; for each named reason how many nulls it holds for."""
    v = F.col(value)
    std = F.when(F.count(v) > 0, F.coalesce(F.stddev(v), F.lit(0.0)))
    out = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), std.alias("std"), F.avg((v > 1.5).cast("double")).alias("share_above"),
        F.avg((v < 1.1).cast("double")).alias("share_below"), F.sum(v.isNull().cast("long")).alias("n_null"),
        *(F.sum((v.isNull() & F.coalesce(c, F.lit(False))).cast("long")).alias(f"n_{name}") for name, c in (reasons or {}).items()),
    )
    middle = quantiles(df, value, [0.5], keys).withColumn("median", F.col("quantiles")[0]).drop("quantiles")
    return (by_keys(out, middle, keys, "left") if keys else out.join(middle, how="left")).select(*keys, "n", "mean", "median", *(c for c in out.columns if c not in (*keys, "n", "mean")))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation and mean absolute difference where both are there; null for two rows or fewer."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = F.count("*")
    return both.agg(n.alias("n"), F.when(n > 2, F.corr(a, b)).alias("pearson"), F.when(n > 2, F.avg(F.abs(F.col(a) - F.col(b)))).alias("mean_abs_diff"))


def ensemble_average(df: DataFrame, item: str, klass: str, prob: str) -> DataFrame:
    """Mean class probabilities of the members by item and the class that wins (the first of equals)."""
    mean = df.groupBy(item, klass).agg(F.avg(prob).alias("p"))
    return mean.groupBy(item).agg(F.max_by(klass, F.struct(F.col("p"), -F.col(klass))).alias("winner"), F.max("p").alias("p"))


def merge_overlapping(windows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the windows' scores for every item; an item that no window covers has 0."""
    mean = windows.groupBy(*keys).agg(F.avg("prob").alias("prob"), F.count("*").alias("covers"))
    return items.join(mean, keys, "left").select(*keys, F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("covers", F.lit(0)).cast("long").alias("covers"))


def best_epoch(history: DataFrame, keys: list[str], metric: str = "metric", patience: int = 6) -> DataFrame:
    """keys, best (epoch of the first maximum), best metric and stop: the epoch where patience runs out, or the last."""
    w = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    running = history.withColumn("_best", F.max(metric).over(w)).withColumn("_fresh", F.when(F.col(metric) > F.coalesce(F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))), F.col("epoch")))
    running = running.withColumn("_since", F.col("epoch") - F.max("_fresh").over(w))
    stop = F.coalesce(F.min(F.when(F.col("_since") >= patience, F.col("epoch"))), F.max("epoch"))
    stopped = running.withColumn("_stop", F.min(F.when(F.col("_since") >= patience, F.col("epoch"))).over(Window.partitionBy(*keys)))
    seen = stopped.filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return seen.groupBy(*keys).agg(F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("best_epoch"), F.max(metric).alias("best_metric"), stop.alias("stop_epoch"))
