"""Splits by sequence, never by item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw, ranked
from .ordering import quantiles
from .sequence import sequence_table


def select_split(df: DataFrame, splits: DataFrame, name: str, seq: str = "seq_id") -> DataFrame:
    return df.join(splits.filter(F.col("split") == name).select(seq), seq, "left_semi")


def split_faults(splits: DataFrame, sequences: DataFrame, expected: list[str], seq: str = "seq_id") -> DataFrame:
    """(fault, n): sequences in several splits, sequences lost, splits without a sequence."""
    shared = splits.groupBy(seq).agg(F.countDistinct("split").alias("k")).filter("k > 1").agg(F.lit("shared").alias("fault"), F.count("*").alias("n"))
    lost = sequences.select(seq).distinct().join(splits, seq, "left_anti").agg(F.lit("lost").alias("fault"), F.count("*").alias("n"))
    there = splits.agg(F.collect_set("split").alias("s"))
    empty = there.select(F.lit("empty").alias("fault"), F.size(F.array_except(F.array(*map(F.lit, expected)), "s")).cast("long").alias("n"))
    return shared.unionByName(lost).unionByName(empty)


def split_official(df: DataFrame, expected: list[str], seq: str = "seq_id") -> DataFrame:
    """(seq, split) from the given folder; an error for a missing or unexpected one."""
    there = {r[0] for r in df.select("orig_split").distinct().limit(len(expected) + 1).collect()}
    if there != set(expected):
        raise ValueError(f"splits are {sorted(map(str, there))}, not {expected}")
    return df.groupBy(seq).agg(F.min("orig_split").alias("split"))


def strata(sequences: DataFrame, rate: str = "pos_rate", bins: int = 4, least: int = 1) -> DataFrame:
    """Adds stratum: 0 for none positive, 1 for all, and the quantile bins of the others from 2 on (right-closed, equal edges once).

    Strata under the least size go to the next, the last to the one before.
    """
    inner = sequences.filter(f"{rate} > 0 and {rate} < 1")
    found = quantiles(inner, rate, [i / bins for i in range(1, bins)]).first()
    edges = sorted(set(found["quantiles"] or []))
    bin_of = F.lit(2)
    for e in edges:
        bin_of = bin_of + (F.col(rate) > e).cast("int")
    out = sequences.withColumn("stratum", F.when(F.col(rate) == 0, 0).when(F.col(rate) == 1, 1).otherwise(bin_of))
    sizes = sorted((r["stratum"], r["count"]) for r in out.groupBy("stratum").count().collect())  # a handful of strata
    to = {s: s for s, _ in sizes}
    for i, (s, n) in enumerate(sizes):
        if n < least and i + 1 < len(sizes):
            nxt, m = sizes[i + 1]
            sizes[i + 1] = (nxt, m + n)
            to = {k: nxt if v == s else v for k, v in to.items()}
    live = [s for s, _ in sizes if s in to.values()]
    if len(live) > 1 and sizes[-1][1] < least:
        to = {k: live[-2] if v == live[-1] else v for k, v in to.items()}
    merged = F.col("stratum")
    for a, b in to.items():
        merged = F.when(F.col("stratum") == a, b).otherwise(merged)
    return out.withColumn("stratum", merged)


def split_regrouped(sequences: DataFrame, seed: int, test: float = 0.2, val: float = 0.2, seq: str = "seq_id", rate: str = "pos_rate") -> DataFrame:
    """(seq, split): within each stratum sequences are dealt in drawn order, one share to test, then one share of the rest to val."""
    labelled = strata(sequences, rate)
    folds = lambda x: max(2, round(1 / x))
    first = labelled.withColumn("_h", draw(seed, "split", seq))
    first = ranked(first, "_h", [seq], ["stratum"], "_place").withColumn("_fold", F.col("_place") % folds(test))
    rest = first.filter("_fold <> 0").drop("_place").withColumn("_h", draw(seed + 1, "split", seq))
    rest = ranked(rest, "_h", [seq], ["stratum"], "_place").withColumn("_fold", F.col("_place") % folds(val / (1 - test)))
    return first.filter("_fold = 0").select(seq, F.lit("test").alias("split")).unionByName(rest.select(seq, F.when(F.col("_fold") == 0, "val").otherwise("train").alias("split")))


def split_profile(df: DataFrame, splits: DataFrame, seq: str = "seq_id", totals: bool = True) -> DataFrame:
    """By split (and over all, as null): sequences, rows, positive rate, regimes, transitions per sequence, and whether there are none."""
    t = sequence_table(df, seq).join(splits, seq)
    grouped = t.rollup("split") if totals else t.groupBy("split")
    return grouped.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("rows"), (F.sum("n_pos") / F.sum("n")).alias("pos_rate"), F.sum((F.col("regime") == "trimmed").cast("long")).alias("trimmed"),
        F.sum((F.col("regime") == "sweep").cast("long")).alias("sweep"), F.avg("n_transitions").alias("transitions_per_sequence"), (F.sum("n_transitions") == 0).alias("no_transitions"),
    )
