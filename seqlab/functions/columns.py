"""Scalar and array functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label words.
POSITIVE = ["1", "true", "yes", "y", "pos", "positive", "standard", "plane", "sp"]
NEGATIVE = ["0", "false", "no", "n", "neg", "negative", "nonstandard", "non-standard", "background", "other", "none", ""]
# Cells that stand for no index.
EMPTY_CELLS = ["", "nan", "none", "null", "[]", "-1"]


def normalise_label(raw: Column, strict: bool = True) -> Column:
    """1 or 0 from words or numbers; an error (or null, if not strict) for anything else."""
    word = F.lower(F.trim(raw))
    number = word.try_cast("double")
    other = F.raise_error(F.concat(F.lit("no label: "), word)).cast("int") if strict else F.lit(None).cast("int")
    return F.when(word.isin(POSITIVE), 1).when(word.isin(NEGATIVE), 0).when(number.isNotNull(), (number > 0).cast("int")).otherwise(other)


def item_ref(path: Column) -> Column:
    """struct(seq, pos): of dir/000345.png the folder and 345; of x_345 or x-345 the lead and number; else the stem and null."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", "")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    tail = F.regexp_extract(stem, r"^(.*)[_-](\d+)$", 2)
    return F.when(stem.rlike(r"^\d+$") & folder.isNotNull(), F.struct(folder.alias("seq"), stem.try_cast("int").alias("pos"))).when(
        tail != "", F.struct(F.regexp_extract(stem, r"^(.*)[_-](\d+)$", 1).alias("seq"), tail.try_cast("int").alias("pos"))
    ).otherwise(F.struct(stem.alias("seq"), F.lit(None).cast("int").alias("pos")))


def expand_index_list(cell: Column, count: Column) -> Column:
    """Sorted distinct integers that a cell names.

    ALL: 0 to count - 1 (an error without count). Blank, nan, none, null, [] and -1: none. [[1,5],[10,15]]:
    inclusive ranges. [10, 15]: two indices. Otherwise ranges a-b, a:b, a~b (either way round) and integers.
    """
    text = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))

    def ranges(pattern: str, source: Column) -> Column:
        found = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
        ends = F.transform(found, numbers)
        return F.flatten(F.transform(ends, lambda e: F.sequence(F.array_min(e), F.array_max(e))))

    nested = ranges(r"\[\s*\d+\s*,\s*\d+\s*\]", text)
    span = r"\d+\s*[-:~]\s*\d+"
    loose = F.concat(ranges(span, text), numbers(F.regexp_replace(text, span, " ")))
    every = F.when(count.isNull(), F.raise_error(F.lit("ALL needs a count")).cast("array<int>")).when(count <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), count.cast("int") - 1))
    none = F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.when(text == "all", every).when(text.isin(EMPTY_CELLS), none).when(text.rlike(r"^\[\s*\["), nested).otherwise(loose)))


def canonical_id(raw: Column) -> Column:
    """X__X becomes X; any other id stays."""
    half = ((F.length(raw) - 2) / 2).cast("int")
    doubled = (F.length(raw) > 2) & (F.length(raw) % 2 == 0) & (F.substr(raw, half + 1, F.lit(2)) == "__") & (F.substr(raw, F.lit(1), half) == F.substr(raw, half + 3, half))
    return F.when(doubled, F.substr(raw, F.lit(1), half)).otherwise(raw)


def session_key(raw: Column) -> Column:
    """The leading time stamp, or else the first 15 characters."""
    stamp = F.regexp_extract(raw, r"^\d{8}T\d{6}", 0)
    return F.when(stamp != "", stamp).otherwise(F.substring(raw, 1, 15))


def exam_prefix(raw: Column) -> Column:
    """The id without a trailing I and number."""
    return F.regexp_replace(raw, r"I\d+$", "")


def classify(raw: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that the id starts with, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(raw.rlike("^(?:" + pattern + ")"), F.lit(name)).otherwise(out)
    return out


SCORE_RULES = {
    "min": lambda a, b: F.least(a, b),
    "geomean": lambda a, b: F.sqrt(F.greatest(a * b, F.lit(0.0))),
    "a": lambda a, b: a,
    "b": lambda a, b: b,
    "sum": lambda a, b: a + b,
}


def combined(a: Column, b: Column, rules: dict | None = None) -> list[Column]:
    """A score_<rule> column for each rule."""
    return [rule(a, b).alias(f"score_{name}") for name, rule in (rules or SCORE_RULES).items()]


def clip_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def has_content(x: Column, mean_at_least: float = 10, level: float = 5, share_at_least: float = 0.10) -> Column:
    n = F.size(x)
    return (n > 0) & (array_sum(x) / n >= mean_at_least) & (F.size(F.filter(x, lambda v: v > level)) / n >= share_at_least)


def activation_map(maps: Column, weights: Column) -> Column:
    """Weighted sum of equally long maps, negative values cut to 0, scaled to 0..1 (a flat map to 0)."""
    zero = F.transform(F.element_at(maps, 1), lambda v: F.lit(0.0))
    pairs = F.arrays_zip(maps.alias("m"), weights.alias("w"))
    total = F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["m"], lambda a, v: a + v * p["w"]))
    cut = F.transform(total, lambda v: F.greatest(v, F.lit(0.0)))
    low, span = F.array_min(cut), F.array_max(cut) - F.array_min(cut)
    return F.transform(cut, lambda v: (v - low) / F.when(span == 0, 1.0).otherwise(span))


def softmax(x: Column) -> Column:
    powers = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(powers, lambda v: v / array_sum(powers))


def argmax(x: Column) -> Column:
    """0-based place of the maximum, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def standardise(x: Column, mean: float, std: float, scale: float = 255.0) -> Column:
    return F.transform(x, lambda v: (v / scale - mean) / std)
