"""The given tables as sequences of labelled items, in Spark and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_sql

#: Seed of all registered queries.
SEED = 7


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a study: users are sequences, some of them trimmed to one label for training, with two scores."""
    e = load(spark, sf_dir, "events")
    split = F.when(F.col("user_id") % 10 < 6, "train").when(F.col("user_id") % 10 < 8, "val").otherwise("test")
    label = F.when(F.col("user_id") % 10 < 6, (F.col("user_id") % 3 != 0).cast("int")).otherwise(F.col("event_type").isin("purchase", "signup").cast("int"))
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    prob = F.col("value") / (F.col("value") + 35)
    out = e.select(F.col("user_id").alias("seq_id"), pos.alias("pos"), label.alias("label"), split.alias("orig_split"), prob.alias("prob"), "event_id", "ts", "event_type", "value")
    return out.withColumn("prob_b", 0.75 * F.col("prob") + 0.25 * (draw(SEED, "prob_b", "event_id") % 1000) / 1000)


STUDY = f"""study as (
  select *, 0.75::double * prob + 0.25::double * ({draw_sql(SEED, "prob_b", "event_id")} % 1000) / 1000 as prob_b from (
    select user_id as seq_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as pos,
      case when user_id % 10 < 6 then cast(user_id % 3 <> 0 as integer) else cast(event_type in ('purchase', 'signup') as integer) end as label,
      case when user_id % 10 < 6 then 'train' when user_id % 10 < 8 then 'val' else 'test' end as orig_split,
      value / (value + 35) as prob, event_id, ts, event_type, value
    from events))"""


def split_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return study(spark, sf_dir).filter(F.col("orig_split") == name)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items: the source is the sequence, the id the position."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("seq_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("orig_split"), F.concat_ws("/", "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".jpg"))).alias("path"))


INVENTORY = "inventory as (select source as seq_id, doc_id as pos, lang as orig_split, concat_ws('/', lang, source, lpad(cast(doc_id as varchar), 6, '0') || '.jpg') as path from documents)"


def partial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select(F.col("source").alias("seq_id"), F.col("doc_id").alias("pos"), F.col("quality").alias("label"), F.col("toxic").alias("marked"))


PARTIAL = "partial as (select source as seq_id, doc_id as pos, quality as label, toxic as marked from documents join labels using (doc_id))"

# Cells by doc_id % 7.
CELLS = ["ALL", "NONE", "1,2,3", "[[1,5],[10,15]]", "10-20", "[10, 15]", ""]
PLAIN_CELLS = ["NONE", "ALL", "4 5 1", "20:18", "[]", "7~9, 30", "-1"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label cells by document, with a count of items."""
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % 7 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), (30 + F.col("n_chars") % 20).cast("int").alias("frame_count"), at(CELLS).alias("pos_cell"), at(PLAIN_CELLS).alias("neg_cell"))


#: What the cells name, by doc_id % 7, before they are cut to the range.
CELL_SETS = "(values (0, null, []), (1, [], null), (2, [1,2,3], [1,4,5]), (3, [1,2,3,4,5,10,11,12,13,14,15], [18,19,20]), (4, [10,11,12,13,14,15,16,17,18,19,20], []), (5, [10,15], [7,8,9,30]), (6, [], [])) as c(k, p, n)"
CELL_TABLE = f"""cells as (
  select doc_id as seq_id, cast(30 + n_chars % 20 as integer) as frame_count, c.k,
    cast(coalesce(c.p, range(0, 30 + n_chars % 20)) as integer[]) as p, cast(coalesce(c.n, range(0, 30 + n_chars % 20)) as integer[]) as n
  from documents join {CELL_SETS} on doc_id % 7 = c.k),
sets as (
  select seq_id, frame_count, k, p, n, [x for x in p if x < frame_count] as positive, [x for x in n if x < frame_count] as in_n from cells),
labelled_cells as (select *, [x for x in in_n if not list_contains(positive, x)] as negative, [x for x in in_n if list_contains(positive, x)] as both_sets from sets)"""


def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run table: for each density k and seed, the mean score of k drawn items of each training sequence is the threshold, and the test split is measured with it."""
    from ..operators.metrics import confusion_metrics

    s = study(spark, sf_dir)
    ks = (1, 5, 20)
    train = s.filter("orig_split = 'train'").select("seq_id", "pos", "prob", F.explode(F.array(*map(F.lit, range(3)))).alias("seed"))
    # a rank depends on the seed alone; each density takes a part of it
    w = Window.partitionBy("seed", "seq_id").orderBy("h", "pos")
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.lit("run"), F.col("seq_id").cast("string"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("bigint")
    ranked = train.withColumn("h", h).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(ks))
    picked = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("r <= k")
    thresholds = picked.groupBy("k", "seed").agg(F.round(F.avg("prob"), 9).alias("threshold"), F.count("*").alias("n_train"))
    test = s.filter("orig_split = 'test'").select("label", "prob").crossJoin(F.broadcast(thresholds))
    count = lambda c: F.sum(c.cast("long"))
    up, y = F.col("prob") >= F.col("threshold"), F.col("label") == 1
    counts = test.groupBy("k", "seed", "n_train").agg(count(y & up).alias("tp"), count(~y & up).alias("fp"), count(y & ~up).alias("fn"), count(~y & ~up).alias("tn"))
    m = confusion_metrics(counts)
    return m.select(F.concat(F.lit("k"), "k").alias("condition"), F.lit("threshold").alias("model"), "seed", F.lit("raw").alias("variant"), "n_train", "macro_f1", "balanced_accuracy", "f1", "precision", "recall")


#: Metric expressions over tp, fp, fn, tn in plain SQL.
SQL_METRICS = {
    "precision": "case when tp + fp > 0 then tp / (tp + fp) else 0 end",
    "recall": "case when tp + fn > 0 then tp / (tp + fn) else 0 end",
    "f1": "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end",
    "macro_f1": "(case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end + case when tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end) / greatest(1, cast(tp + fp + fn > 0 as integer) + cast(tn + fp + fn > 0 as integer))",
    "balanced_accuracy": "(case when tp + fn > 0 then tp / (tp + fn) else 0 end + case when tn + fp > 0 then tn / (tn + fp) else 0 end) / greatest(1, cast(tp + fn > 0 as integer) + cast(tn + fp > 0 as integer))",
    "mcc": "case when sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) > 0 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end",
    "accuracy": "case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) else 0 end",
    "specificity": "case when tn + fp > 0 then tn / (tn + fp) end",
    "prevalence": "case when tp + fp + fn + tn > 0 then (tp + fn) / (tp + fp + fn + tn) else 0 end",
}


def counts_sql(up: str, source: str, keys: str = "") -> str:
    """select keys, tp, fp, fn, tn (doubles) from a source."""
    one = lambda y, p: f"cast(count(*) filter (where label = {y} and {'' if p else 'not '}({up})) as double)"
    group = f" group by {keys}" if keys else ""
    return f"select {keys + ', ' if keys else ''}{one(1, True)} as tp, {one(0, True)} as fp, {one(1, False)} as fn, {one(0, False)} as tn from {source}{group}"


GRID = f"""{STUDY},
settings as (select k, seed from (values (1), (5), (20)) a(k), (values (0), (1), (2)) b(seed)),
picked as (select k, seed, prob, row_number() over (partition by k, seed, seq_id order by {draw_sql("cast(seed as varchar)", "run", "seq_id", "pos")}, pos) as r from study, settings where orig_split = 'train'),
thresholds as (select k, seed, round(avg(prob), 9) as threshold, count(*) as n_train from picked where r <= k group by k, seed),
counts as ({counts_sql("prob >= threshold", "study, thresholds where orig_split = 'test'", "k, seed, n_train")}),
runs as (select 'k' || k as condition, 'threshold' as model, seed, 'raw' as variant, n_train, {", ".join(f"{SQL_METRICS[m]} as {m}" for m in ("macro_f1", "balanced_accuracy", "f1", "precision", "recall"))} from counts)"""
