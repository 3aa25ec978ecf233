"""Rows in a total order over many tasks: ranges with sampled borders, numbers, and exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a block, as a power of two; blocks are what one task holds in order.
BLOCK_BITS = 16


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a table in shared storage with _row, a number that grows in the order, and _block, of at most 65,536 neighbouring rows.

    Spark samples the borders of ranges of neighbouring rows, so no key, and no sequence, has to be in one
    task. The table is written as another sample would give other borders.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    return stored(rows, "ranged").withColumn("_block", F.shiftright("_row", BLOCK_BITS))


def by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right is one row
    other = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(other, on, how).drop(*(f"_r_{c}" for c in keys))


def pieces(rows: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Of ranged rows in the order of (keys, ...): for each block and key its rows (_n), its first row (_low), the rows of the key before it (_before) and in all (_all), and more aggregates."""
    out = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_low"), *(c.alias(name) for name, c in more.items()))
    whole = in_turn(keys)
    return out.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")), "_all": F.sum("_n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))})


def in_turn(keys: list[str]):
    """Blocks of a key in their order: few rows, as a key has one for 65,536 of its rows and one more for each task."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_block")


def numbered(df: DataFrame, order: str | list[str], keys: list[str] | None = None, name: str = "number") -> DataFrame:
    """Adds a row's place from 0 in the order, of columns of any type that has one and unique by keys."""
    keys = keys or []
    rows = ranged(df, [*keys, *([order] if isinstance(order, str) else order)])
    places = pieces(rows, keys).select(*keys, "_block", "_before", "_low")
    return by_keys(rows, places, [*keys, "_block"]).withColumn(name, F.col("_before") + F.col("_row") - F.col("_low")).drop("_row", "_block", "_before", "_low")


#: Ranges that values are counted by in a round, and rounds.
BINS, ROUNDS = 4096, 2


def quantiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys and quantiles, an array with the exact quantile (linear between neighbours) of each share; nulls don't count, and keys without values have no row (without keys there is one, null where there are no values).

    A rank is looked for by counts: values between the least and the most are counted by range, combined
    before the shuffle, then only those in the range that the rank lies in, by its ranges, and at last the
    different values left there. No group's values are ever in one task.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    rows = stored(rows, "values")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).filter("_n > 0")
    at = F.array(*(F.struct(F.lit(k).alias("share"), ((F.col("_n") - 1) * F.lit(float(q))).alias("place")) for k, q in enumerate(shares)))
    wanted = sizes.select("*", F.explode(at).alias("_q")).select("*", F.explode(F.array_distinct(F.array(F.floor("_q.place"), F.ceil("_q.place")))).alias("_rank"))
    targets = wanted.select(*keys, "_rank", "_low", "_high", F.lit(0).cast("long").alias("_below")).distinct()
    each = [*keys, "_rank"]
    for _ in range(ROUNDS):
        inside = near(rows, stored(targets, "targets"), keys)
        bin_ = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS))).otherwise(0)
        counts = inside.withColumn("_bin", bin_).groupBy(*each, "_below", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*each).orderBy("_bin"))
        found = counts.withColumn("_upto", upto).filter(F.col("_rank").between(F.col("_upto") - F.col("_n"), F.col("_upto") - 1))
        targets = found.select(*each, "_low", "_high", (F.col("_upto") - F.col("_n")).alias("_below"))
    left = near(rows, stored(targets, "targets"), keys).groupBy(*each, "_below", "_v").agg(F.count("*").alias("_n"))
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*each).orderBy("_v"))
    found = left.withColumn("_upto", upto).filter(F.col("_rank").between(F.col("_upto") - F.col("_n"), F.col("_upto") - 1)).select(*each, "_v")
    ends = by_keys(wanted.select(*keys, "_q", "_rank"), found, each)
    low, high, part = F.min("_v"), F.max("_v"), F.col("_place") - F.floor("_place")
    one = ends.groupBy(*keys, F.col("_q.share").alias("_share"), F.col("_q.place").alias("_place")).agg(low.alias("_a"), high.alias("_b"))
    one = one.withColumn("_v", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - part) + F.col("_b") * part))
    return one.groupBy(*keys).agg(F.when(F.count("*") > 0, F.transform(F.array_sort(F.collect_list(F.struct("_share", "_v"))), lambda x: x["_v"])).alias("quantiles"))


def near(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the ranges of the targets; there are two for each share and key at most."""
    other = targets.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in targets.columns))
    if keys:
        out = rows.join(other, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]).drop(*(f"_r_{c}" for c in keys))
    else:
        out = rows.crossJoin(F.broadcast(other))
    return out.filter(F.col("_v").between(F.col("_low"), F.col("_high")))
