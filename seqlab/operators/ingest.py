"""Integrity-checked ingest: inventories, label tables, keys and their faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import expand_index_list
from .ordering import quantiles


class IngestError(ValueError):
    """A table breaks a rule that later steps rely on."""


def resolve_column(columns: list[str], candidates: list[str], denied: tuple[str, ...] = (), exact: bool = False) -> str | None:
    """The column that matches the first candidate: equal without regard to case, then (unless exact) as a substring."""
    free = [c for c in columns if c.lower() not in {d.lower() for d in denied}]
    for want in candidates:
        for c in free:
            if c.lower() == want.lower():
                return c
    for want in () if exact else candidates:
        for c in free:
            if want.lower() in c.lower():
                return c
    return None


def reject_scalar_column(labels: DataFrame, seq: str, label: str) -> DataFrame:
    """labels_per_sequence, distinct_labels and usable of a label table."""
    per = labels.groupBy(seq).agg(F.count("*").alias("n")).agg(F.avg("n").alias("labels_per_sequence"))
    kinds = labels.agg(F.countDistinct(label).alias("distinct_labels"))
    return per.crossJoin(kinds).withColumn("usable", (F.col("labels_per_sequence") >= 1.5) & (F.col("distinct_labels") > 1))


def decode_codes(df: DataFrame, table: DataFrame, split: str, raw: str, zero_background: bool = True, strict: bool = False) -> DataFrame:
    """Adds class by (split, raw code) from a code table (split, code, class); 0 is background; unknown codes are null or, if strict, an error."""
    named = df.join(table.select(F.col("split").alias(split), F.col("code").alias(raw), "class"), [split, raw], "left")
    if zero_background:
        named = named.withColumn("class", F.when(F.col(raw) == 0, 0).otherwise(F.col("class")))
    if strict:
        what = F.concat(F.lit("unknown code "), F.coalesce(F.col(raw).cast("string"), F.lit("null")), F.lit(" in "), F.coalesce(F.col(split).cast("string"), F.lit("null")))
        named = named.withColumn("class", F.when(F.col("class").isNull(), F.raise_error(what).cast("int")).otherwise(F.col("class")))
    return named


def unknown_codes(decoded: DataFrame, split: str, raw: str) -> DataFrame:
    return decoded.filter("class is null").groupBy(split, raw).agg(F.count("*").alias("n"))


def label_sets(cells: DataFrame, seq: str = "seq_id", count: str = "frame_count", pos: str = "pos_cell", neg: str = "neg_cell") -> DataFrame:
    """Per sequence: both sets cut to the range, their overlap (positive wins), what is out of range, what nobody labelled, and whether sentinels partition."""
    p, n = expand_index_list(F.col(pos), F.col(count)), expand_index_list(F.col(neg), F.col(count))
    inside = lambda a: F.filter(a, lambda x: (x >= 0) & (x < F.col(count)))
    sets = cells.withColumns({"_p": p, "_n": n}).withColumns({"positive": inside(F.col("_p")), "_in_n": inside(F.col("_n"))})
    sentinel = F.upper(F.trim(pos)).isin("ALL", "NONE") | F.upper(F.trim(neg)).isin("ALL", "NONE")
    overlap = F.array_intersect("positive", "_in_n")
    out = sets.withColumn("negative", F.array_except("_in_n", "positive"))
    return out.select(
        seq, count, "positive", "negative", F.size(overlap).alias("n_overlap"), (F.size("_p") - F.size("positive") + F.size("_n") - F.size("_in_n")).alias("n_out_of_range"),
        (F.col(count) - F.size("positive") - F.size("negative")).cast("int").alias("n_unannotated"), sentinel.alias("has_sentinel"),
        (~sentinel | ((F.size(overlap) == 0) & (F.size("positive") + F.size("negative") == F.col(count)))).alias("sentinel_ok"),
    )


def explode_labels(sets: DataFrame, seq: str = "seq_id") -> DataFrame:
    one = lambda c, y: sets.select(seq, F.explode(c).alias("pos"), F.lit(y).alias("label"))
    return one("positive", 1).unionByName(one("negative", 0))


def ingest_stats(sets: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c.cast("long"))
    return sets.agg(
        F.count("*").alias("sequences"), total(F.size("positive")).alias("positives"), total(F.size("negative")).alias("negatives"), total(F.col("n_unannotated")).alias("unannotated"),
        total(F.col("n_out_of_range")).alias("out_of_range"), total(F.col("n_overlap")).alias("overlap"), total(F.col("has_sentinel")).alias("sentinels"),
    )


def label_conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys whose copies disagree: keys, copies, labels."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"), F.countDistinct(label).alias("labels")).filter("labels > 1")


def dedupe_labels(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row by key, the first in the given order, ascending. Spark keeps one row by key in each task before the shuffle, and only columns that are used later are moved."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def label_items(items: DataFrame, labels: DataFrame, keys: list[str], marker: str | None = None) -> DataFrame:
    """Every item with its label, -1 where there is none, and the marker, 0 where there is none."""
    out = items.join(labels, keys, "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    return out.withColumn(marker, F.coalesce(marker, F.lit(0))) if marker else out


def join_completeness(labelled: DataFrame, split: str) -> DataFrame:
    return labelled.groupBy(split).agg(F.count("*").alias("n"), F.avg((F.col("label") >= 0).cast("double")).alias("rate"))


def require_complete(labelled: DataFrame, split: str, seq: str, least: float = 1.0) -> DataFrame:
    """labelled itself; an error with some ids where a split's rate is below the least."""
    low = [r[split] for r in join_completeness(labelled, split).filter(F.col("rate") < least).collect()]
    if low:
        ids = [r[0] for r in labelled.filter("label < 0").select(seq).distinct().orderBy(seq).limit(5).collect()]
        raise IngestError(f"splits {low} are not fully labelled, for example {ids}")
    return labelled


def reconcile(declared: DataFrame, actual: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Declared and actual counts that differ."""
    out = declared.select(key, F.col(count).alias("declared")).join(actual.select(key, F.col(count).alias("actual")), key, "left")
    return out.withColumn("actual", F.coalesce("actual", F.lit(0).cast("long"))).filter("declared <> actual")


def manifest(items: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Items by declared key, 0 where there are none."""
    return declared.select(key).join(items.groupBy(key).agg(F.count("*").alias("n_items")), key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))


def longest_prefix(stems: DataFrame, ids: DataFrame, stem: str = "stem", known: str = "id") -> DataFrame:
    """Adds id (the stem itself, or the longest known id that is followed by _) and rest's first integer: prefixes are exploded at each _, so the join is on equal keys."""
    parts = F.split(stem, "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    hits = stems.select(stem, F.explode(prefixes).alias(known)).join(ids.select(known).distinct(), known)
    best = hits.groupBy(stem).agg(F.max_by(known, F.length(known)).alias(known))
    out = stems.join(best, stem, "left")
    rest = F.substr(F.col(stem), F.length(known) + 2)
    return out.withColumn("pos", F.when(F.col(stem) == F.col(known), F.lit(None)).otherwise(F.regexp_extract(rest, r"(\d+)", 1).try_cast("int")))


def granularity(labelled: DataFrame, split: str, seq: str) -> DataFrame:
    """By split: sequences, how many have a single label, and whether all have (weak labels)."""
    per = labelled.groupBy(split, seq).agg((F.min("label") == F.max("label")).alias("single"))
    return per.groupBy(split).agg(F.count("*").alias("sequences"), F.sum(F.col("single").cast("long")).alias("single_label"), F.bool_and("single").alias("weak"))


def length_profile(labelled: DataFrame, seq: str) -> DataFrame:
    per = labelled.groupBy(seq).agg(F.count("*").alias("n"), F.max("label").alias("top"))
    rest = per.agg(F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.sum((F.col("top") > 0).cast("long")).alias("with_positive"))
    median = quantiles(per, "n", [0.5]).select(F.col("quantiles")[0].alias("median_rows"))
    return rest.crossJoin(F.broadcast(median)).select("min_rows", "median_rows", "max_rows", "with_positive")


def unique_ids(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds uid: the stem if no other path has it, else the last three parts joined by __, with a number where these meet too."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", "")
    long = F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), F.lit(3)), "__"), r"\.[A-Za-z0-9]+$", "")
    named = paths.withColumn("_stem", stem).withColumn("_n", F.count("*").over(Window.partitionBy("_stem"))).withColumn("_id", F.when(F.col("_n") == 1, F.col("_stem")).otherwise(long))
    turn = F.row_number().over(Window.partitionBy("_id").orderBy(path))
    return named.withColumn("_t", turn).withColumn("uid", F.when(F.col("_t") == 1, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_t").cast("string")))).drop("_stem", "_n", "_id", "_t")


def distinct_head(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return df.select(*keys).distinct().orderBy(*keys).limit(n)
