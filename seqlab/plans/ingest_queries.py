"""Queries of sources, scalar functions, ingest joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import experiments, ingest, sampling, sequence
from ..sources import bindings as B
from ..sources import files
from ..sources.shared import fresh_path
from .common import Registry

R = Registry()
study, load = B.study, B.load

# --- sources -------------------------------------------------------------------------------------


@R.add("s1_read_items", f"with {B.INVENTORY} select path, split_part(path, '/', 1) as split, split_part(path, '/', 2) as raw, split_part(path, '/', 2) as seq_id, cast(pos as integer) as pos from inventory")
def s1(spark, d):
    return files.items_of_paths(B.inventory(spark, d))


@R.add("s1_id_collisions", f"with {B.INVENTORY} select orig_split as split, seq_id, cast(0 as bigint) as folders from inventory where false")
def s1b(spark, d):
    return files.id_collisions(files.items_of_paths(B.inventory(spark, d)))


@R.add("s3_union_label_files", "select case when doc_id % 2 = 0 then 'even' else 'odd' end as file, count(*) as rows, count(*) filter (where quality = 1) as positives from labels group by 1")
def s3(spark, d):
    y = load(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), F.lit(0).alias("pos"), F.col("quality").alias("label"))
    parts = {"even": y.filter("seq_id % 2 = 0"), "odd": y.filter("seq_id % 2 = 1"), "unusable": load(spark, d, "region")}
    return files.contributions(files.union_label_files(parts))


@R.add("s5_manifest", "select s_suppkey, coalesce(n, 0)::bigint as n_items from supplier left join (select l_suppkey, count(*) as n from lineitem group by 1) on l_suppkey = s_suppkey")
def s5(spark, d):
    items = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    return ingest.manifest(items, load(spark, d, "supplier"), "s_suppkey")


@R.add("s6_assign_unique_ids", """
with p as (select url as path, string_split(url, '/') as a from pages),
s as (select path, regexp_replace(a[-1], '\\.[A-Za-z0-9]+$', '') as stem, regexp_replace(array_to_string(a[greatest(1, len(a) - 2):], '__'), '\\.[A-Za-z0-9]+$', '') as long from p),
n as (select *, count(*) over (partition by stem) as k from s),
i as (select path, case when k = 1 then stem else long end as id from n),
t as (select *, row_number() over (partition by id order by path) as r from i)
select path, case when r = 1 then id else id || '_' || r end as uid from t""")
def s6(spark, d):
    return ingest.unique_ids(load(spark, d, "pages").select(F.col("url").alias("path"))).select("path", "uid")


@R.add("s8_read_runs", f"with {B.GRID} select condition || '-' || seed as run, condition, n_train, seed, model, variant, macro_f1, balanced_accuracy, f1 from runs", "macro_f1 balanced_accuracy f1")
def s8(spark, d):
    g = B.grid_runs(spark, d)
    nested = g.select(
        F.concat_ws("-", "condition", "seed").alias("run"), F.struct(F.col("condition").alias("name"), F.col("n_train")).alias("condition"), "seed", F.col("model").alias("model_type"),
        F.create_map(F.col("variant"), F.create_map(*(x for m in ("macro_f1", "balanced_accuracy", "f1") for x in (F.lit(m), F.col(m))))).alias("results"),
    )
    return files.flatten_runs(nested).drop("auroc", "auprc")


@R.add("s11_list_annotations", "select lang as split, count(*) filter (where d.doc_id % 3 = 1) as unmatched from documents d where doc_id % 3 in (0, 1) group by lang")
def s11(spark, d):
    items = B.inventory(spark, d)
    known = items.filter("pos % 3 <> 1")
    layout = lambda k, folder: items.filter(f"pos % 3 = {k}").select("seq_id", "pos", F.col("orig_split").alias("split"), F.concat(F.lit(folder), "path").alias("path"))
    return files.list_annotations([layout(0, "masks/"), layout(1, "extra/")], known)[1]


@R.add("s11_three_layouts", "select lang as split, case doc_id % 3 when 0 then 'masks' else 'extra' end as layout, count(*) as n from documents where doc_id % 3 in (0, 1) group by all union all select lang, 'named', count(*) from (select distinct source, lang from documents where doc_id % 3 = 2) group by 1")
def s11b(spark, d):
    """All three layouts: masks with a position in their names, of two folders, and masks that are named by their sequence."""
    items = B.inventory(spark, d)
    layout = lambda k, folder: items.filter(f"pos % 3 = {k}").select("seq_id", "pos", F.col("orig_split").alias("split"), F.concat(F.lit(folder), F.lit("/"), "path").alias("path"))
    info = items.filter("pos % 3 = 2").select("seq_id", F.col("orig_split").alias("split"), "pos")
    names = info.select("seq_id", "split").distinct().withColumn("path", F.concat_ws("/", F.lit("named"), "split", "seq_id"))
    found, _ = files.list_annotations([layout(0, "masks"), layout(1, "extra"), files.located(names, info)], items)
    return found.groupBy("split", F.split("path", "/")[0].alias("layout")).agg(F.count("*").alias("n"))


# --- files written to shared storage and read again -----------------------------------------------


@R.add("s2_read_labels_csv", "select cast(doc_id as varchar) as filename, cast(quality as varchar) as label, 'utf-8' as encoding from labels")
def s2(spark, d):
    path = fresh_path(spark, "labels")
    load(spark, d, "labels").select(F.col("doc_id").alias("filename"), F.col("quality").alias("label")).write.csv(path, header=True)
    table, found = files.read_labels_csv(spark, path)
    return table.withColumn("encoding", F.lit(found))


@R.add("s4_write_index", f"with {B.INVENTORY}, y as (select doc_id as pos, quality from labels) select orig_split, count(*) as items, count(quality) as labelled, min(pos) as first, max(pos) as last from inventory left join y using (pos) group by 1")
def s4(spark, d):
    path = fresh_path(spark, "index")
    items = B.inventory(spark, d).join(B.partial_labels(spark, d).select("seq_id", "pos", "label"), ["seq_id", "pos"], "left")
    files.write_index(items, path)
    return spark.read.parquet(path).groupBy("orig_split").agg(F.count("*").alias("items"), F.count("label").alias("labelled"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@R.add("s7_splits", f"with {B.STUDY} select distinct seq_id, orig_split as split from study")
def s7(spark, d):
    path = fresh_path(spark, "splits")
    files.write_splits(study(spark, d).select("seq_id", F.col("orig_split").alias("split")).distinct(), path)
    return files.read_splits(spark, path)


@R.add("s8_read_runs_files", f"with {B.GRID} select condition || '-' || seed as run, condition, n_train, seed, model, variant, macro_f1, balanced_accuracy, f1 from runs", "macro_f1 balanced_accuracy f1")
def s8b(spark, d):
    """Run results as nested JSON files, read by folder."""
    path = fresh_path(spark, "runs")
    nested = B.grid_runs(spark, d).select(
        F.concat_ws("-", "condition", "seed").alias("run"), F.struct(F.col("condition").alias("name"), F.col("n_train")).alias("condition"), "seed", F.col("model").alias("model_type"),
        F.create_map(F.col("variant"), F.create_map(*(x for m in ("macro_f1", "balanced_accuracy", "f1") for x in (F.lit(m), F.col(m))))).alias("results"),
    )
    nested.repartition(F.col("run")).write.option("maxRecordsPerFile", 1).json(path)
    return files.read_runs(spark, path).drop("auroc", "auprc")


@R.add("s9_predictions", f"with {B.STUDY} select run, count(*) as n, sum(label)::bigint as positives, avg(prob) as mean from (select 'a' as run, label, prob from study where orig_split = 'test' union all select 'b', label, prob_b from study where orig_split = 'test') group by 1", "mean")
def s9(spark, d):
    path, s = fresh_path(spark, "predictions"), study(spark, d).filter("orig_split = 'test'")
    part = lambda run, p: s.select(F.lit(run).alias("run"), "seq_id", "pos", "label", F.col(p).alias("prob"))
    files.write_predictions(part("a", "prob").unionByName(part("b", "prob_b")), path)
    return files.read_predictions(spark, path).groupBy("run").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("prob").alias("mean"))


@R.add("s10_report", f"with {B.STUDY} select orig_split, count(*) as n, sum(label)::bigint as positives from study group by 1")
def s10(spark, d):
    path = fresh_path(spark, "report")
    files.write_report(study(spark, d).groupBy("orig_split").agg(F.count("*").alias("n"), F.sum("label").alias("positives")), path)
    return spark.read.schema("orig_split string, n long, positives long").json(path)


_NAMED = ", ".join(f"('{c.name}', {'null' if c.k is None else c.k})" for c in sampling.CONDITIONS)


@R.add("s12_conditions_rows", f"with {B.STUDY}, c(name, k) as (values {_NAMED}), s as (select seq_id, count(*) as n from study where orig_split = 'train' group by 1) select name, cast(k as integer) as k, count(*) as sequences, sum(n)::bigint as available, sum(least(n, coalesce(k, n)))::bigint as at_most from c, s group by 1, 2")
def s12(spark, d):
    """What each condition's density leaves of the train split at most, from a histogram of lengths."""
    lengths = study(spark, d).filter("orig_split = 'train'").groupBy("seq_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m"))
    settings = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.k).cast("int").alias("k")) for c in sampling.CONDITIONS))
    rows = lengths.select("n", "m", F.explode(settings).alias("c"))
    return rows.groupBy("c.name", "c.k").agg(F.sum("m").alias("sequences"), F.sum(F.col("n") * F.col("m")).alias("available"), F.sum(F.least(F.col("n"), F.coalesce("c.k", "n")) * F.col("m")).alias("at_most"))


# --- projections and scalar functions ------------------------------------------------------------


@R.add("p1_normalise_label", "select event_id, case when event_type = 'purchase' then 1 when event_type = 'signup' then 0 when event_id % 3 = 0 then cast(event_id % 2 as integer) else cast(value > 0 as integer) end as label from events")
def p1(spark, d):
    raw = F.when(F.col("event_type") == "purchase", " Positive").when(F.col("event_type") == "signup", "NO ").when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 1, "yes").otherwise("Background")).otherwise(F.col("value").cast("string"))
    return load(spark, d, "events").select("event_id", C.normalise_label(raw).alias("label"))


@R.add("p2_parse_item_ref", "select doc_id, case doc_id % 3 when 0 then source when 1 then source || '_a' else source || 'x' end as seq, case when doc_id % 3 < 2 then cast(doc_id as integer) end as pos from documents")
def p2(spark, d):
    number = F.lpad(F.col("doc_id").cast("string"), 6, "0")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a/"), "source", F.lit("/"), number, F.lit(".png"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("_a-"), number)).otherwise(F.concat("source", F.lit("x.jpg")))
    return load(spark, d, "documents").select("doc_id", C.item_ref(ref).alias("r")).select("doc_id", "r.seq", "r.pos")


@R.add("p3_expand_index_list", f"with {B.CELL_TABLE} select seq_id, len(p)::bigint as n, coalesce(list_sum(p), 0)::bigint as total, coalesce(array_to_string(list_sort(p), ','), '') as items from cells")
def p3(spark, d):
    x = B.cells(spark, d).select("seq_id", C.expand_index_list(F.col("pos_cell"), F.col("frame_count")).alias("a"))
    return x.select("seq_id", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.array_join("a", ",").alias("items"))


@R.add("p4_canonical_id", "select page_id, split_part(url, '/', 3) as host from pages")
def p4(spark, d):
    host = F.element_at(F.split("url", "/"), 3)
    return load(spark, d, "pages").select("page_id", C.canonical_id(F.when(F.col("page_id") % 2 == 0, F.concat(host, F.lit("__"), host)).otherwise(host)).alias("host"))


@R.add("p5_resolve_column_rows", "select user_id as seq_id, count(*) as n from events group by 1")
def p5(spark, d):
    e = load(spark, d, "events")
    found = ingest.resolve_column(e.columns, ["video", "USER_ID", "user"], ("event_id",))
    return e.groupBy(F.col(found).alias("seq_id")).agg(F.count("*").alias("n"))


@R.add("p6_reject_scalar_column", "select avg(n) as labels_per_sequence, (select count(distinct l_linenumber) from lineitem) as distinct_labels, true as usable from (select l_orderkey, count(*) as n from lineitem group by 1)", "labels_per_sequence")
def p6(spark, d):
    return ingest.reject_scalar_column(load(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def code_table(spark):
    return spark.createDataFrame([("1-URGENT", 7, 1), ("1-URGENT", 8, 2), ("2-HIGH", 127, 1), ("2-HIGH", 255, 2), ("3-MEDIUM", 7, 1), ("5-LOW", 8, 2)], "split string, code int, class int")


def coded_orders(spark, d):
    status = F.col("o_orderstatus")
    code = F.when(status == "F", 7).when(status == "O", 127).otherwise(0)
    return load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("split"), code.alias("raw"))


CODED = "coded as (select o_orderkey, o_orderpriority as split, case o_orderstatus when 'F' then 7 when 'O' then 127 else 0 end as raw from orders), codes as (select * from (values ('1-URGENT', 7, 1), ('1-URGENT', 8, 2), ('2-HIGH', 127, 1), ('2-HIGH', 255, 2), ('3-MEDIUM', 7, 1), ('5-LOW', 8, 2)) t(split, code, class))"


@R.add("p7_decode_codes", f"with {CODED} select o_orderkey, a.split, a.raw, case when raw = 0 then 0 else class end as class from coded a left join codes b on a.split = b.split and a.raw = b.code")
def p7(spark, d):
    return ingest.decode_codes(coded_orders(spark, d), code_table(spark), "split", "raw").select("o_orderkey", "split", "raw", "class")


@R.add("p7_unknown_codes", f"with {CODED} select a.split, a.raw, count(*) as n from coded a left join codes b on a.split = b.split and a.raw = b.code where raw <> 0 and class is null group by 1, 2")
def p7b(spark, d):
    return ingest.unknown_codes(ingest.decode_codes(coded_orders(spark, d), code_table(spark), "split", "raw"), "split", "raw")


STAMPED = "case when event_id % 2 = 0 then strftime(ts, '%Y%m%dT%H%M%S') || 'I' || (event_id % 10) else 'device-' || user_id || '-clip-' || event_id end"


def stamped():
    return F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("I"), (F.col("event_id") % 10).cast("string"))).otherwise(F.concat(F.lit("device-"), F.col("user_id").cast("string"), F.lit("-clip-"), F.col("event_id").cast("string")))


@R.add("p8_session_key", f"select event_id, substr({STAMPED}, 1, 15) as session from events")
def p8(spark, d):
    return load(spark, d, "events").select("event_id", C.session_key(stamped()).alias("session"))


@R.add("p9_classify_by_pattern", "select c, count(*) as n, count(*) filter (where c is null) as unmatched from (select case when url like 'https://blog.%' then 'blog' when url like 'https://%' then 'secure' when url like 'http://www.%' then 'www' end as c from pages) group by c")
def p9(spark, d):
    c = C.classify(F.col("url"), [("blog", r"https://blog\."), ("secure", "https://"), ("www", r"http://www\.")])
    return load(spark, d, "pages").select(c.alias("c")).groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("c").isNull().cast("long")).alias("unmatched"))


@R.add("p10_exam_prefix", f"select event_id, regexp_replace({STAMPED}, 'I[0-9]+$', '') as exam from events")
def p10(spark, d):
    return load(spark, d, "events").select("event_id", C.exam_prefix(stamped()).alias("exam"))


@R.add("p11_combine_scores", f"with {B.STUDY} select event_id, least(prob, prob_b) as score_min, sqrt(prob * prob_b) as score_geomean, prob as score_a, prob_b as score_b, prob + prob_b as score_sum from study", "score_min score_geomean score_a score_b score_sum")
def p11(spark, d):
    return study(spark, d).select("event_id", *C.combined(F.col("prob"), F.col("prob_b")))


@R.add("p12_apply_threshold", f"with {B.STUDY} select event_id, cast(prob >= case orig_split when 'val' then 0.4 when 'test' then 0.6 else 0.5 end as integer) as predicted from study")
def p12(spark, d):
    cut = F.broadcast(spark.createDataFrame([("train", 0.5), ("val", 0.4), ("test", 0.6)], "orig_split string, threshold double"))
    return study(spark, d).join(cut, "orig_split").select("event_id", (F.col("prob") >= F.col("threshold")).cast("int").alias("predicted"))


@R.add("p13_clip_logit", f"with {B.STUDY} select event_id, ln(q / (1 - q)) as logit from (select event_id, greatest(1e-6::double, least(1 - 1e-6::double, prob)) as q from study)", "logit")
def p13(spark, d):
    return study(spark, d).select("event_id", C.clip_logit(F.col("prob")).alias("logit"))


def images(spark, d):
    """Embeddings as small images of 0 to 255."""
    return load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 400).cast("double")).alias("x"))


IMAGES = "images as (select vec_id, label, [floor(abs(cast(v as double)) * 400) for v in embedding] as x from embeddings)"


@R.add("p14_has_content", f"with {IMAGES} select vec_id, list_sum(x) / len(x) >= 40 and len([v for v in x if v > 60]) / len(x) >= 0.22 as content from images")
def p14(spark, d):
    return images(spark, d).select("vec_id", C.has_content(F.col("x"), 40, 60, 0.22).alias("content"))


@R.add("p15_activation_map", f"""with {IMAGES}, m as (select vec_id, [greatest(0.5 * x[i] - 0.75 * x[i + 16] + 0.25 * x[i + 32] + 0.5 * x[i + 48], 0) for i in range(1, 17)] as c from images)
select vec_id, list_sum([(v - list_min(c)) / (case when list_max(c) = list_min(c) then 1 else list_max(c) - list_min(c) end) for v in c]) as mass, list_position(c, list_max(c)) - 1 as peak from m""", "mass")
def p15(spark, d):
    maps = F.array(*(F.slice("x", 1 + 16 * i, 16) for i in range(4)))
    cam = images(spark, d).select("vec_id", C.activation_map(maps, F.array(F.lit(0.5), F.lit(-0.75), F.lit(0.25), F.lit(0.5))).alias("c"))
    return cam.select("vec_id", C.array_sum(F.col("c")).alias("mass"), C.argmax(F.col("c")).alias("peak"))


@R.add("p16_softmax_argmax", "with e as (select vec_id, [exp(cast(v as double) - list_max([cast(w as double) for w in embedding])) for v in embedding] as p, [cast(w as double) for w in embedding] as x from embeddings) select vec_id, list_max(p) / list_sum(p) as top, cast(list_position(x, list_max(x)) - 1 as integer) as klass from e", "top")
def p16(spark, d):
    x = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return x.select("vec_id", F.array_max(C.softmax(F.col("x"))).alias("top"), C.argmax(F.col("x")).alias("klass"))


@R.add("p17_standardise_array", f"with {IMAGES} select vec_id, list_sum([(v / 255 - 0.25) / 0.5 for v in x]) as total from images", "total")
def p17(spark, d):
    return images(spark, d).select("vec_id", C.array_sum(C.standardise(F.col("x"), 0.25, 0.5)).alias("total"))


@R.add("p18_filter_labelled", "select d.doc_id, quality as label from documents d join labels using (doc_id) where quality >= 0")
def p18(spark, d):
    keys = B.inventory(spark, d)
    return ingest.label_items(keys, B.partial_labels(spark, d).select("seq_id", "pos", "label"), ["seq_id", "pos"]).filter("label >= 0").select(F.col("pos").alias("doc_id"), "label")


@R.add("p19_is_single_class", f"with {B.STUDY} select seq_id, cast(round_even(avg(label), 0) as integer) as label, min(label) = max(label) as single from study group by seq_id")
def p19(spark, d):
    return study(spark, d).groupBy("seq_id").agg(F.bround(F.avg("label")).cast("int").alias("label"), (F.min("label") == F.max("label")).alias("single"))


@R.add("p20_label_sets", f"""with {B.CELL_TABLE} select seq_id, frame_count, len(positive)::integer as n_positive, len(negative)::integer as n_negative, len(both_sets)::integer as n_overlap,
(len(p) - len(positive) + len(n) - len(in_n))::integer as n_out_of_range, (frame_count - len(positive) - len(negative))::integer as n_unannotated, k in (0, 1) as has_sentinel, true as sentinel_ok from labelled_cells""")
def p20(spark, d):
    s = ingest.label_sets(B.cells(spark, d))
    return s.select("seq_id", "frame_count", F.size("positive").alias("n_positive"), F.size("negative").alias("n_negative"), "n_overlap", "n_out_of_range", "n_unannotated", "has_sentinel", "sentinel_ok")


# --- joins ---------------------------------------------------------------------------------------

LABELLED = f"{B.INVENTORY}, {B.PARTIAL}, labelled as (select i.seq_id, i.pos, i.orig_split, coalesce(p.label, -1) as label, coalesce(p.marked, 0) as marked from inventory i left join partial p using (seq_id, pos))"


def labelled(spark, d):
    return ingest.label_items(B.inventory(spark, d), B.partial_labels(spark, d), ["seq_id", "pos"], "marked")


@R.add("j1_label_items", f"with {LABELLED} select seq_id, pos, label, marked from labelled")
def j1(spark, d):
    return labelled(spark, d).select("seq_id", "pos", "label", "marked")


@R.add("j2_join_completeness", f"with {LABELLED} select orig_split, count(*) as n, avg(cast(label >= 0 as double)) as rate from labelled group by 1", "rate")
def j2(spark, d):
    return ingest.join_completeness(labelled(spark, d), "orig_split")


@R.add("j3_reconcile_manifest", """with a as (select l_suppkey as k, count(*) as n from lineitem group by 1), q as (select s_suppkey as k, cast(s_suppkey % 2 + 590 as bigint) as n from supplier)
select k as s_suppkey, q.n as declared, coalesce(a.n, 0) as actual from q left join a using (k) where q.n <> coalesce(a.n, 0)""")
def j3(spark, d):
    declared = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 + 590).alias("n"))
    actual = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return ingest.reconcile(declared, actual, "s_suppkey")


@R.add("j6_longest_prefix_join", """with s as (select doc_id, source || '_' || lang || '_' || (doc_id % 50) as stem from documents), i as (select distinct source as id from documents union select distinct source || '_' || lang from documents where lang in ('en', 'de')),
h as (select doc_id, stem, id, row_number() over (partition by doc_id order by length(id) desc) as r from s join i on starts_with(stem, id || '_'))
select doc_id, id, try_cast(regexp_extract(substr(stem, length(id) + 2), '([0-9]+)', 1) as integer) as pos from h where r = 1""")
def j6(spark, d):
    docs = load(spark, d, "documents")
    stems = docs.select("doc_id", F.concat_ws("_", "source", "lang", (F.col("doc_id") % 50).cast("string")).alias("stem"))
    ids = docs.select(F.col("source").alias("id")).unionByName(docs.filter("lang in ('en', 'de')").select(F.concat_ws("_", "source", "lang").alias("id"))).distinct()
    found = ingest.longest_prefix(stems.select("stem").distinct(), ids)
    return stems.join(found, "stem").select("doc_id", "id", "pos")


@R.add("j7_semi_on_key", f"with {B.INVENTORY} select count(*) filter (where d.doc_id is not null) as kept, count(*) filter (where d.doc_id is null) as dropped from (select doc_id * 2 as doc_id from labels) y left join documents d using (doc_id)")
def j7(spark, d):
    marks = load(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    docs = load(spark, d, "documents").select("doc_id")
    kept, dropped = marks.join(docs, "doc_id", "left_semi"), marks.join(docs, "doc_id", "left_anti")
    return kept.agg(F.count("*").alias("kept")).crossJoin(dropped.agg(F.count("*").alias("dropped")))


@R.add("j8_attach_attributes", "select doc_id, quality, toxic, lang, source from labels left join documents using (doc_id)")
def j8(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", "left").select("doc_id", "quality", "toxic", "lang", "source")


@R.add("j13_ordered_lookup", "select t.event_type, n, rank, grp from (select event_type, count(*) as n from events group by 1) t join (values ('purchase', 1, 'buy'), ('signup', 2, 'join'), ('view', 3, 'look'), ('never', 4, 'none')) o(event_type, rank, grp) using (event_type)")
def j13(spark, d):
    order = spark.createDataFrame([("purchase", 1, "buy"), ("signup", 2, "join"), ("view", 3, "look"), ("never", 4, "none")], "event_type string, rank int, grp string")
    return experiments.ordered_lookup(load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), order, "event_type").select("event_type", "n", "rank", "grp")


@R.add("j14_compare_predictions", f"with {B.STUDY} select count(*) as n, max(abs(prob - prob_b)) as max_abs_diff, avg(cast((prob >= 0.5) = (prob_b >= 0.5) as double)) as agreement, max(abs(prob - prob_b)) <= 0.25 as passed from study", "max_abs_diff agreement")
def j14(spark, d):
    s = study(spark, d)
    return experiments.compare_predictions(s.select("seq_id", "pos", "prob"), s.select("seq_id", "pos", F.col("prob_b").alias("prob")), ["seq_id", "pos"], 0.5, 0.25)


@R.add("j15_centred_window", """with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as o, count(*) over (partition by conv_id) as n from conversations),
t as (select conv_id, any_value(n) as n, count(*) filter (where turn < 3) as lead_n from c group by 1),
w as (select conv_id, slot, least(greatest(0, least(lead_n - 2, n - 4)) + slot, n - 1) as o from t, range(4) r(slot))
select w.conv_id, 3 as target, cast(slot as integer) as slot, turn from w join c using (conv_id, o)""")
def j15(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn")
    return sequence.centred_window(c, c.select("conv_id", F.lit(3).alias("target")).distinct(), 4, "conv_id", "turn").select("conv_id", "target", "slot", "turn")


# --- aggregations of ingest ----------------------------------------------------------------------


@R.add("a15_label_conflicts", "select l_orderkey, l_linenumber, count(*) as copies, count(distinct l_returnflag) as labels from lineitem group by 1, 2 having count(distinct l_returnflag) > 1")
def a15(spark, d):
    return ingest.label_conflicts(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@R.add("a15_dedupe_labels", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag) as r from lineitem) where r = 1")
def a15b(spark, d):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag")]
    return ingest.dedupe_labels(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@R.add("a16_label_granularity", f"with {B.STUDY} select orig_split, count(*) as sequences, count(*) filter (where single) as single_label, bool_and(single) as weak from (select orig_split, seq_id, min(label) = max(label) as single from study group by 1, 2) group by 1")
def a16(spark, d):
    return ingest.granularity(study(spark, d), "orig_split", "seq_id")


@R.add("a17_length_profile", f"with {B.STUDY} select min(n) as min_rows, median(n) as median_rows, max(n) as max_rows, count(*) filter (where t > 0) as with_positive from (select seq_id, count(*) as n, max(label) as t from study group by 1)", "median_rows")
def a17(spark, d):
    return ingest.length_profile(study(spark, d), "seq_id")


@R.add("a31_ingest_stats", f"""with {B.CELL_TABLE} select count(*) as sequences, sum(len(positive))::bigint as positives, sum(len(negative))::bigint as negatives, sum(frame_count - len(positive) - len(negative))::bigint as unannotated,
sum(len(p) - len(positive) + len(n) - len(in_n))::bigint as out_of_range, sum(len(both_sets))::bigint as overlap, count(*) filter (where k in (0, 1)) as sentinels from labelled_cells""")
def a31(spark, d):
    return ingest.ingest_stats(ingest.label_sets(B.cells(spark, d)))


# --- set operations ------------------------------------------------------------------------------


@R.add("u1_union_all", "select kind, count(*) as n from (select 'order' as kind, o_orderkey as k from orders union all select 'line', l_orderkey from lineitem union all select 'line', l_orderkey from lineitem where l_quantity > 40) group by 1")
def u1(spark, d):
    line = load(spark, d, "lineitem")
    one = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("k"))
    return one(load(spark, d, "orders"), "order", "o_orderkey").unionByName(one(line, "line", "l_orderkey")).unionByName(one(line.filter("l_quantity > 40"), "line", "l_orderkey")).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("u2_intersect", "select user_id as seq_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'signup'")
def u2(spark, d):
    e = load(spark, d, "events")
    of = lambda t: e.filter(F.col("event_type") == t).select(F.col("user_id").alias("seq_id"))
    return of("purchase").intersect(of("signup"))


@R.add("u3_except", "select doc_id from documents except select doc_id from labels")
def u3(spark, d):
    return load(spark, d, "documents").select("doc_id").distinct().join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@R.add("u4_distinct", "select distinct l_orderkey, l_linenumber from lineitem")
def u4(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()
