"""Random draws as pure functions of a seed, a purpose and a key, and running totals without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *keys: Column | str) -> Column:
    """A 32-bit integer (as bigint) that depends on nothing but its arguments."""
    parts = [F.lit(str(seed)), F.lit(purpose), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def draw_sql(seed: int | str, purpose: str, *keys: str) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', {seed if isinstance(seed, str) else repr(str(seed))}, '{purpose}', {', '.join(keys)})), 1, 8))::BIGINT)"


def running_total(df: DataFrame, value: str, bucket: str, order: list[Column], keys: list[str] | None = None, name: str = "running") -> DataFrame:
    """Adds the sum of value up to and including each row, in the order of (bucket, order).

    Two levels: sums by bucket, of which there are few, then a window within each bucket. bucket must
    be monotone in the order; ties in order count as one row.
    """
    keys = keys or []
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.partitionBy(F.lit(0)).orderBy(bucket)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0) if len(order) == 1 else Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(before, [*keys, bucket])
    return joined.withColumn(name, F.col("_before") + F.sum(value).over(within)).drop("_before")


def ranked(df: DataFrame, value: str, ties: list[str], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds a row's place from 0 by (a 32-bit draw, ties), in two levels: 4,096 ranges of draws, then within a range."""
    marked = df.withColumns({"_one": F.lit(1).cast("long"), "_range": F.shiftright(F.col(value), 20)})
    return running_total(marked, "_one", "_range", [F.col(value), *map(F.col, ties)], keys, name).withColumn(name, F.col(name) - 1).drop("_one", "_range")


def lowest(df: DataFrame, n: int, value: str, ties: list[str], keys: list[str] | None = None) -> DataFrame:
    """The n rows with the lowest (32-bit draw, ties), by keys if any; all where there are fewer.

    Rows are counted by range of draws, 4,096 rows by keys at most. Ranges that fit are taken whole; only the one range that the n-th row lies in is sorted.
    """
    keys = keys or []
    marked = df.withColumn("_range", F.shiftright(F.col(value), 20))
    sizes = marked.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    upto = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.sum("_size").over(upto.orderBy("_range")) - F.col("_size")).filter(F.col("_before") < n)
    near = marked.join(sizes, [*keys, "_range"])
    whole, edge = near.filter(F.col("_before") + F.col("_size") <= n), near.filter(F.col("_before") + F.col("_size") > n)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value, *ties))
    return whole.unionByName(edge.withColumn("_place", place).filter(F.col("_place") <= n - F.col("_before")).drop("_place")).drop("_range", "_size", "_before")
