"""Readers and writers of item inventories, label files, splits, runs, predictions and reports."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_id
from ..operators.ingest import IngestError
from ..operators.sampling import Condition
from .shared import fresh_path

# Encodings to try, in order (Spark's name behind each).
ENCODINGS = [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("gb18030", "GB18030"), ("big5", "Big5"), ("cp1252", "windows-1252"), ("latin-1", "ISO-8859-1")]

RUN_SCHEMA = "run string, condition struct<name:string,n_train:bigint>, seed int, model_type string, results map<string, map<string, double>>, history array<struct<epoch:int,metric:double>>"


# The manifest's columns.
MANIFEST = "video_id, stem, split, source, n_frames"


def items_of_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """path, split, raw (the folder), seq_id (canonical) and pos of .../split/sequence/NNNNNN.jpg; other paths are left out."""
    pattern = r"([^/]+)/([^/]+)/(\d+)\.(?:jpg|jpeg|png)$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return files.filter(F.col(path).rlike(pattern)).select(F.col(path).alias("path"), part(1).alias("split"), part(2).alias("raw"), canonical_id(part(2)).alias("seq_id"), part(3).cast("int").alias("pos"))


def id_collisions(items: DataFrame) -> DataFrame:
    """Canonical ids that several folders of a split share."""
    return items.groupBy("split", "seq_id").agg(F.countDistinct("raw").alias("folders")).filter("folders > 1")


def read_items(spark: SparkSession, root: str) -> DataFrame:
    """The inventory under a root; an error if it is empty or if folders collapse to one id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    items = items_of_paths(files)
    if items.isEmpty():
        raise IngestError(f"no items under {root}")
    clash = id_collisions(items).limit(5).collect()
    if clash:
        raise IngestError(f"folders share an id: {[r['seq_id'] for r in clash]}")
    return items


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file as bytes. Spark cuts files of any size into ranges; no encoding of the list has a line break inside a character, so no character is cut."""
    return spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("raw"))


def fitting_encoding(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The first encoding of the list that all of the file's bytes are valid in, and whether a quoted cell goes over a line break. Every task tries its lines; the driver gets a row of flags."""
    names = [name for name, _ in ENCODINGS if name != "utf-8-sig"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, odd = dict.fromkeys(names, True), False
        for batch in batches:
            lines = batch.column("raw").to_pylist()
            odd = odd or any(x.count(b'"') % 2 for x in lines)
            whole = b"\n".join(lines)
            for name in names:
                if fits[name]:
                    try:
                        whole.decode(name)
                    except UnicodeDecodeError:
                        fits[name] = False
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*fits.values(), odd)], names=[*(f"fits{k}" for k in range(len(names))), "odd"])

    flags = raw_lines(spark, path).mapInArrow(judged, ", ".join(f"fits{k} boolean" for k in range(len(names))) + ", odd boolean")
    row = flags.agg(*(F.bool_and(f"fits{k}").alias(f"fits{k}") for k in range(len(names))), F.bool_or("odd").alias("odd")).first()
    found = next(name for k, name in enumerate(names) if row[f"fits{k}"] is not False)
    return "utf-8-sig" if found == "utf-8" and has_mark(spark, path) else found, bool(row["odd"])


def has_mark(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with a byte order mark. Spark's reader leaves it out, so the file is longer than its lines by more than a last line break."""
    lines = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_size", (F.octet_length("value") + 1).alias("n"))
    sizes = lines.groupBy("file_path").agg((F.max("file_size") - F.sum("n")).alias("more"))
    return bool(sizes.agg(F.max("more") >= 2).first()[0])


def detect_encoding(spark: SparkSession, path: str) -> str:
    return fitting_encoding(spark, path)[0]


def read_labels_csv(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, str]:
    """The table, all columns text, and the encoding that fitted, or the one that is given.

    Lines are decoded where they are read, so a file may have any size. Where a quoted cell goes over a line
    break, Spark reads each file as a whole. Files of a folder have the same header; lines like it are headers.
    """
    found, broken = fitting_encoding(spark, path)
    found = encoding or found
    if found not in dict(ENCODINGS):
        raise IngestError(f"encoding is one of {[name for name, _ in ENCODINGS]}")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x.decode("utf-8-sig" if found.startswith("utf-8") else found).rstrip("\r") for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    lines = raw_lines(spark, path).mapInArrow(decoded, "line string").filter("line <> ''")
    if broken:
        folder = fresh_path(spark, "decoded")
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("raw")).mapInArrow(decoded, "line string")
        whole.write.option("lineSep", "\n").text(folder)
        return spark.read.csv(folder, header=True, multiLine=True), found
    first = lines.first()
    if first is None:
        raise IngestError(f"no lines under {path}")
    names = next(csv.reader([first["line"]]))
    cells = F.from_csv("line", ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    return lines.filter(F.col("line") != first["line"]).select(cells.alias("cells")).select("cells.*"), found


def union_label_files(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables that have a sequence, a position and a label, with their file's name; an error if none has."""
    usable = {k: v for k, v in tables.items() if {"seq_id", "pos", "label"} <= set(v.columns)}
    if not usable:
        raise IngestError("no label file can be used")
    out = None
    for name, t in usable.items():
        one = t.select("seq_id", "pos", "label").withColumn("file", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def contributions(labels: DataFrame) -> DataFrame:
    return labels.groupBy("file").agg(F.count("*").alias("rows"), F.sum((F.col("label") == 1).cast("long")).alias("positives"))


def write_index(index: DataFrame, path: str) -> None:
    index.repartitionByRange("seq_id", "pos").sortWithinPartitions("seq_id", "pos").write.partitionBy("orig_split").parquet(path)


def write_splits(splits: DataFrame, path: str, scheme: str | None = None, seed: int | None = None, diagnostics: DataFrame | None = None) -> None:
    """The table of splits under path/splits; with diagnostics, a profile by split, also these with the scheme and the seed under path/diagnostics."""
    splits.select("seq_id", "split").write.parquet(f"{path}/splits")
    if diagnostics is not None:
        named = diagnostics.withColumns({"scheme": F.lit(scheme).cast("string"), "seed": F.lit(seed).cast("int")})
        named.coalesce(1).write.json(f"{path}/diagnostics")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/splits").select("seq_id", "split")


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/diagnostics")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest (video_id, stem, split, source, n_frames) as CSV."""
    manifest.select(*MANIFEST.split(", ")).write.option("header", "true").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with its types; an error for a row without an id or with a count that is no number."""
    rows = spark.read.option("header", "true").csv(path).withColumn("_n", F.col("n_frames").try_cast("long"))
    sound = F.when(F.col("video_id").isNull() | F.col("_n").isNull(), F.raise_error(F.lit("a manifest row lacks an id or a count")).cast("boolean")).otherwise(True)
    return rows.filter(sound).select("video_id", "stem", "split", "source", F.col("_n").alias("n_frames"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("run", "seq_id", "pos", "label", "prob").write.partitionBy("run").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One row by run and variant with the numeric metrics of the results map."""
    names = ["macro_f1", "balanced_accuracy", "f1", "auroc", "auprc"]
    rows = runs.select("run", F.col("condition.name").alias("condition"), F.col("condition.n_train").alias("n_train"), "seed", F.col("model_type").alias("model"), F.explode("results").alias("variant", "m"))
    return rows.select("run", "condition", "n_train", "seed", "model", "variant", *(F.col("m")[n].alias(n) for n in names))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All result files under a root; an error if there is none."""
    out = flatten_runs(spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "*.json").json(root))
    if out.isEmpty():
        raise IngestError(f"no results under {root}")
    return out


def write_report(table: DataFrame, path: str, kind: str = "json") -> None:
    """A small finished table as one file: json, csv or, as text, a Markdown table."""
    if kind == "markdown":
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns)), F.lit(" |"))
        head = table.sparkSession.createDataFrame([("| " + " | ".join(table.columns) + " |",), ("|" + "---|" * len(table.columns),)], "value string")
        head.unionByName(table.select(row.alias("value"))).coalesce(1).write.text(path)
    else:
        table.coalesce(1).write.format(kind).option("header", "true").save(path)


def list_annotations(layouts: list[DataFrame], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations of all layouts (seq_id, pos, split, path) whose item is known, and by split how many are not."""
    every = layouts[0]
    for other in layouts[1:]:
        every = every.unionByName(other)
    marked = every.join(known.select("seq_id", "pos").distinct().withColumn("_known", F.lit(True)), ["seq_id", "pos"], "left")
    return marked.filter("_known").drop("_known"), marked.groupBy("split").agg(F.sum(F.col("_known").isNull().cast("long")).alias("unmatched"))


def located(names: DataFrame, info: DataFrame) -> DataFrame:
    """The layout whose files are named by the sequence alone: names (seq_id, split, path) with the position that info (seq_id, split, pos) has for the sequence; null where it has none. Of several the smallest."""
    place = info.groupBy("seq_id", "split").agg(F.min("pos").alias("pos"))
    return names.join(place, ["seq_id", "split"], "left").select("seq_id", "pos", "split", "path")


def conditions_table(spark: SparkSession, conditions: list[Condition]) -> DataFrame:
    rows = [(c.name, c.k, c.strategy, c.stride, c.budget, c.budget_unit, c.target_pos_rate) for c in conditions]
    return spark.createDataFrame(rows, "name string, k int, strategy string, stride int, budget int, budget_unit string, target_pos_rate double")


def load_conditions(spark: SparkSession, path: str) -> list[Condition]:
    """Conditions from JSON, a list of objects, each with a name and any of the other fields; an error for unknown fields, a missing name or a name that repeats."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect())  # a setting, a file of some lines
    known = set(Condition.__dataclass_fields__)
    out: list[Condition] = []
    for entry in json.loads(text):
        if extra := set(entry) - known:
            raise IngestError(f"conditions have no {sorted(extra)}")
        if not entry.get("name") or entry["name"] in {c.name for c in out}:
            raise IngestError(f"a condition's name is missing or repeats: {entry}")
        out.append(Condition(**entry))
    return out
