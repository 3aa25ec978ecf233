"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, passages
that repeat go, and what is left is packed into training sequences.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir), docs with the columns of
documents, and returns a DataFrame; each stage's result is written as Parquet and read again.

Decisions are made by row: a null doc_id, or rows that share one, change nothing for toxicity and
quality. Near copies: rows with a null id are no copies of others; a class is one of ids, so rows that
share an id stay or go together, and equal rows (id and text) stay once. Null and empty texts stay as
they are. Columns besides those of documents are dropped; an empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import near_dup, packing, quality, substring, toxicity
from seqlab.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is under the operator's threshold. Each row is judged by its own text."""
    scored = toxicity.scores(docs, table(spark, sf_dir, "labels"), carry=tuple(COLUMNS))
    return scored.filter("predicted = 0").select(COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier keeps. Each row is judged by its own text and metadata."""
    scored = quality.scores(docs, table(spark, sf_dir, "labels"), carry=tuple(COLUMNS))
    return scored.filter("keep").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies, and of rows that repeat an id and a text one."""
    classes = near_dup.classes(docs)
    copies = classes.filter("doc_id <> class_id").select("doc_id")
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the passages out of each document that a document with a smaller id has; the text of others stays as it is."""
    out = substring.removed(docs.withColumnRenamed("text", "whole"), text_col="whole", keep=("whole", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.select("doc_id", F.when(changed, F.col("kept")).otherwise(F.col("whole")).alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("substrings", drop_repeats),
    ("packing", pack),
]

#: SQL has no way to state trained models and BPE. tests/llm holds near duplicates, substrings and packing against
#: brute force, and the two classifiers against their models by definition and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
