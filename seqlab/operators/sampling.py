"""Which items of which sequences: density, budgets and priors, all by draws that depend on keys alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, lowest, running_total
from .ordering import numbered, quantiles
from .sequence import runs, with_ordinal


def even_picks(count: str, k: int):
    """Distinct ordinals: all if there are at most k, the middle for k = 1, else k half-even rounded places from first to last."""
    n = F.col(count).cast("int")
    if k == 1:
        return F.array((n / 2).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * ((n - 1) / F.lit(float(k - 1)))).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(spread))


def sample_uniform(df: DataFrame, k: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    lengths = df.groupBy(seq).agg(F.count("*").alias("_n"))
    picks = lengths.select(seq, F.explode(even_picks("_n", k)).alias("ordinal"))
    return with_ordinal(df, seq, pos).join(picks, [seq, "ordinal"]).drop("ordinal", "n")


def sample_random(df: DataFrame, k: int, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    w = Window.partitionBy(seq).orderBy("_h", pos)
    return df.withColumn("_h", draw(seed, "random", seq, pos)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_h", "_r")


def sample_curated(df: DataFrame, k: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Centres of positive runs, the first k, filled up with evenly placed negatives; the middle item where nothing is left."""
    rows = with_ordinal(df, seq, pos)
    centres = runs(df, "label", seq, pos).filter("value = 1").select(seq, F.col("centre").alias("ordinal"))
    first = Window.partitionBy(seq).orderBy("ordinal")
    chosen = centres.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r")
    have = chosen.groupBy(seq).agg(F.count("*").cast("int").alias("_have"))
    negatives = rows.filter("label = 0").select(seq, "ordinal", (F.row_number().over(first) - 1).alias("_i"))
    room = negatives.groupBy(seq).agg(F.count("*").cast("int").alias("_n")).join(have, seq, "left").withColumn("_want", F.least(F.lit(k) - F.coalesce("_have", F.lit(0)), F.col("_n"))).filter("_want > 0")
    place = F.when(F.col("_want") == 1, F.array(F.floor(F.col("_n") / 2).cast("int"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_want") - 1), lambda i: F.bround(i * ((F.col("_n") - 1) / (F.col("_want") - 1).cast("double"))).cast("int"))))
    filled = room.select(seq, F.explode(place).alias("_i")).join(negatives, [seq, "_i"]).select(seq, "ordinal")
    return rows.join(chosen.unionByName(filled).distinct(), [seq, "ordinal"], "left_semi").drop("ordinal", "n")


STRATEGIES = {"uniform": lambda df, k, seed: sample_uniform(df, k), "random": sample_random, "curated": lambda df, k, seed: sample_curated(df, k)}


def sample_per_sequence(df: DataFrame, k: int | None, strategy: str = "uniform", seed: int = 0, selectors: dict | None = None) -> DataFrame:
    """k items of each sequence by a named strategy, of STRATEGIES or of a caller's selectors (df, k, seed) -> df; no k keeps all."""
    if k is None:
        return df
    known = STRATEGIES | (selectors or {})
    if strategy not in known:
        raise ValueError(f"no strategy {strategy}")
    return known[strategy](df, k, seed)


def stride_sample(df: DataFrame, stride: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    return with_ordinal(df, seq, pos).filter(F.col("ordinal") % stride == 0).drop("ordinal", "n")


def budget_items(df: DataFrame, budget: int, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Exactly budget random items (all, if fewer): those with the lowest draws."""
    return lowest(df.withColumn("_h", draw(seed, "budget", seq, pos)), budget, "_h", [seq, pos]).drop("_h")


def sequence_shares(df: DataFrame, budget: int, seed: int, keys: list[str] | None = None, budgets: DataFrame | None = None, seq: str = "seq_id") -> DataFrame:
    """(seq, n, take): whole sequences in drawn order while they fit; the first that doesn't gives what is left."""
    keys = keys or []
    sizes = df.groupBy(*keys, seq).agg(F.count("*").alias("n")).withColumn("_h", draw(seed, "order", seq)).withColumn("_bucket", F.shiftright("_h", 20))
    total = running_total(sizes, "n", "_bucket", [F.col("_h"), F.col(seq)], keys, "_upto")
    total = total.join(budgets, keys) if budgets is not None else total.withColumn("_budget", F.lit(budget))
    left = F.col("_budget") - (F.col("_upto") - F.col("n"))
    return total.withColumn("take", F.least(F.col("n"), left)).filter("take > 0").select(*keys, seq, "n", "take")


def budget_sequences(df: DataFrame, budget: int, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Whole sequences up to exactly budget items; the last is a contiguous chunk that starts at a drawn place."""
    return chunk(df, sequence_shares(df, budget, seed, seq=seq), seed, seq, pos)


def chunk(df: DataFrame, shares: DataFrame, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    start = draw(seed, "chunk", seq) % (F.col("n") - F.col("take") + 1)
    placed = shares.select(seq, "take", F.when(F.col("take") < F.col("n"), start).otherwise(F.lit(0)).alias("_from"))
    return with_ordinal(df, seq, pos).drop("n").join(placed, seq).filter("ordinal >= _from and ordinal < _from + take").drop("ordinal", "take", "_from")


def budget_and_prior(df: DataFrame, budget: int, rate: float, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """round(budget x rate) items from sequences that are mostly positive and the rest from the others, each as budget_sequences."""
    want = round(budget * rate)
    kinds = df.groupBy(seq).agg((F.avg(F.col("label").cast("double")) > 0.5).cast("int").alias("_kind"))
    budgets = df.sparkSession.createDataFrame([(1, want), (0, budget - want)], "_kind int, _budget long")
    shares = sequence_shares(df.join(kinds, seq), 0, seed, ["_kind"], budgets, seq)
    return chunk(df, shares, seed, seq, pos)


def budget_report(picked: DataFrame, budget: int, rate: float | None = None, tolerance: float = 0.02) -> DataFrame:
    """One row: rows, budget, short (fewer rows than asked for), pos_rate and off_prior (further from the wanted rate than the tolerance; null without one)."""
    n, p = F.count("*"), F.avg(F.col("label").cast("double"))
    off = F.lit(None).cast("boolean") if rate is None else F.abs(F.coalesce(p, F.lit(0.0)) - rate) > tolerance
    return picked.agg(n.alias("rows"), F.lit(budget).cast("long").alias("budget"), (n < budget).alias("short"), p.alias("pos_rate"), off.alias("off_prior"))


@dataclass(frozen=True)
class Condition:
    """A named sampling setting."""

    name: str
    k: int | None = None
    strategy: str = "uniform"
    stride: int | None = None
    budget: int | None = None
    budget_unit: str = "frame"
    target_pos_rate: float | None = None


# The conditions of the study.
CONDITIONS = [
    Condition("sparse_k1", 1), Condition("sparse_k2", 2), Condition("sparse_k5", 5), Condition("sparse_k10", 10), Condition("sparse_k20", 20),
    Condition("dense_s8", stride=8), Condition("dense_s4", stride=4), Condition("dense_s2", stride=2), Condition("dense_all"),
    Condition("dense_matched_k5", budget=2170, budget_unit="video"), Condition("dense_matched_k20", budget=8638, budget_unit="video"),
    Condition("dense_frames_k5", budget=2170), Condition("dense_prior_matched_k5", budget=2170, budget_unit="video", target_pos_rate=0.6129),
]


def build_condition(df: DataFrame, c: Condition, seed: int) -> DataFrame:
    """Density, then stride, then budget."""
    out = sample_per_sequence(df, c.k, c.strategy, seed)
    if c.stride:
        out = stride_sample(out, c.stride)
    if c.budget is None:
        return out
    if c.target_pos_rate is not None:
        return budget_and_prior(out, c.budget, c.target_pos_rate, seed)
    return budget_items(out, c.budget, seed) if c.budget_unit == "frame" else budget_sequences(out, c.budget, seed)


def compute_budgets(df: DataFrame, conditions: list[Condition], seed: int = 0) -> DataFrame:
    """(name, size) of conditions without a budget; dense_matched_kN takes the size of sparse_kN, null where there is none."""
    sizes = None
    for c in conditions:
        if c.budget is None:
            one = build_condition(df, c, seed).agg(F.lit(c.name).alias("name"), F.count("*").alias("size"))
            sizes = one if sizes is None else sizes.unionByName(one)
    wanted = df.sparkSession.createDataFrame([(c.name,) for c in conditions if c.budget is not None], "name string")
    source = F.concat(F.lit("sparse_"), F.regexp_extract("name", r"matched_(k\d+)$", 1))
    matched = wanted.withColumn("_source", source).join(sizes.withColumnRenamed("name", "_source"), "_source", "left").select("name", "size")
    return sizes.unionByName(matched)


def describe(df: DataFrame, seq: str = "seq_id") -> DataFrame:
    per = df.groupBy(seq).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("sequences"), (F.sum("p") / F.sum("n")).alias("pos_rate")).crossJoin(F.broadcast(quantiles(per, "n", [0.5]).select(F.col("quantiles")[0].alias("median_rows"))))


def balanced_sample(df: DataFrame, n: int, seed: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """n // 2 random items of each label (all, if fewer)."""
    return lowest(df.withColumn("_h", draw(seed, "balanced", seq, pos)), n // 2, "_h", [seq, pos], ["label"]).drop("_h")


def even_rows(df: DataFrame, n: int, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """n rows at truncated even places over the whole table in (seq, pos) order. A row knows by its own place whether it is one of them."""
    total = df.agg(F.count("*").alias("_all"))
    rows = numbered(df, [seq, pos], name="_place").crossJoin(F.broadcast(total))
    step = (F.col("_all") - 1) / F.lit(max(n - 1, 1))
    near = F.floor(F.col("_place") / step)
    hit = lambda i: (i >= 0) & (i < n) & (F.floor(i * (F.col("_all") - 1) / F.lit(max(n - 1, 1))) == F.col("_place"))
    return rows.filter(F.when(F.col("_all") <= 1, F.lit(n > 0)).otherwise(hit(near) | hit(near + 1) | hit(near + 2))).drop("_place", "_all")


def first_last(df: DataFrame, qualifies, klass: str, order: str, strict: bool = False) -> DataFrame:
    """First and last qualifying row of each class; where there are fewer than two, null or, if strict, an error."""
    ok = df.filter(qualifies)
    if strict:
        few = F.when(F.count("*") < 2, F.raise_error(F.lit("a class has fewer than two rows that qualify")).cast("long")).otherwise(F.count("*"))
        return ok.groupBy(klass).agg(few.alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    return ok.groupBy(klass).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last")).withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("first", "last")})


def top1_per_sequence(df: DataFrame, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    best = df.groupBy(seq).agg(F.max_by(F.struct(pos, "label", "prob"), F.struct(F.col("prob"), -F.col(pos))).alias("b"))
    return best.select(seq, f"b.{pos}", "b.label", "b.prob")
