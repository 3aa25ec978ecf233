"""Queries of metrics, sequences, sampling, splitting, inference, experiments, models and streams."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.draws import draw, draw_sql
from ..operators import experiments, inference, metrics, model, sampling, sequence, splitting
from ..sources import bindings as B
from ..sources.bindings import SEED, SQL_METRICS, STUDY, counts_sql, load, split_of, study
from ..streaming import causal
from .common import Registry

R = Registry()
ITEM = ["precision", "recall", "f1", "macro_f1", "balanced_accuracy", "mcc", "accuracy", "specificity", "prevalence"]
ITEM_SQL = ", ".join(f"{SQL_METRICS[m]} as {m}" for m in ITEM)
GRID100 = "(select cast(k as integer) as k, k / 100.0::double as t from range(1, 100) g(k))"


def item_sql(up: str, source: str, keys: str) -> str:
    """Keys, long counts and all item metrics."""
    return f"select {keys}, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, (tp + fp + fn + tn)::bigint as n, {ITEM_SQL} from ({counts_sql(up, source, keys)})"


def curve_sql(source: str, keys: str, metric: str = "macro_f1", prob: str = "prob") -> str:
    return f"select {keys}, k, t, {SQL_METRICS[metric]} as m from ({counts_sql(f'{prob} >= t', f'{source}, {GRID100}', f'{keys}, k, t')})"


def best_sql(source: str, keys: str, metric: str = "macro_f1", prob: str = "prob") -> str:
    return f"select {keys}, t as threshold, m as {metric} from (select *, row_number() over (partition by {keys} order by m desc, k) as r from ({curve_sql(source, keys, metric, prob)})) where r = 1"


def rank_sql(source: str, keys: str, prob: str = "prob") -> str:
    return f"""select {keys}, case when p > 0 and n > 0 then area / (p * n) end as auroc, case when p > 0 then steps / p end as auprc from (
      select {keys}, sum(pos)::double as p, sum(neg)::double as n, sum(neg * (cp - pos + 0.5::double * pos)) as area, sum(pos * cp / (cp + cn)) as steps from (
        select *, (sum(pos) over w)::double as cp, (sum(neg) over w)::double as cn from (
          select {keys}, {prob} as s, (count(*) filter (where label = 1))::double as pos, (count(*) filter (where label <> 1))::double as neg from {source} group by {keys}, {prob})
        window w as (partition by {keys} order by s desc)) group by {keys})"""


# --- sampling descriptions and sequence tables ----------------------------------------------------


@R.add("a1_describe", f"with {STUDY} select sum(n)::bigint as rows, count(*) as sequences, (sum(p) / sum(n))::double as pos_rate, median(n)::double as median_rows from (select seq_id, count(*) as n, sum(label) as p from study group by 1)", "pos_rate median_rows")
def a1(spark, d):
    return sampling.describe(study(spark, d))


LAGGED = f"{STUDY}, lagged as (select *, coalesce(cast(lag(label) over (partition by seq_id order by pos) <> label as integer), 0) as is_transition from study)"
SEQUENCES = f"{LAGGED}, sequences as (select seq_id, count(*) as n, sum(label)::bigint as n_pos, arg_min(orig_split, pos) as orig_split, avg(label) as pos_rate, sum(is_transition)::bigint as n_transitions, case when sum(is_transition) = 0 then 'trimmed' else 'sweep' end as regime from lagged group by 1)"


@R.add("a2_sequence_table", f"with {SEQUENCES} select * from sequences", "pos_rate")
def a2(spark, d):
    return sequence.sequence_table(study(spark, d))


@R.add("a3_class_weights", f"with {STUDY} select count(*) / (2.0::double * count(*) filter (where label <> 1)) as w0, count(*) / (2.0::double * count(*) filter (where label = 1)) as w1 from study where orig_split = 'train'", "w0 w1")
def a3(spark, d):
    return metrics.class_weights(split_of(spark, d, "train"))


@R.add("a4_confusion_metrics", f"with {STUDY} {item_sql('prob >= 0.5', 'study', 'orig_split')}", " ".join(ITEM))
def a4(spark, d):
    return metrics.confusion_metrics(metrics.confusion_counts(study(spark, d), F.col("prob") >= 0.5, ["orig_split"]))


@R.add("a5_auroc", f"with {STUDY} select orig_split, auroc from ({rank_sql('study', 'orig_split')})", "auroc")
def a5(spark, d):
    return metrics.ranking_metrics(study(spark, d), ["orig_split"]).select("orig_split", "auroc")


@R.add("a6_auprc", f"with {STUDY} select orig_split, auprc from ({rank_sql('study', 'orig_split', 'prob_b')})", "auprc")
def a6(spark, d):
    return metrics.ranking_metrics(study(spark, d), ["orig_split"], prob="prob_b").select("orig_split", "auprc")


SEQ_METRICS = """select orig_split, avg(case when y = 1 then top::double end) as top1_precision, avg(case when y = 1 then fired::double end) as detection_rate, avg(case when y = 0 then fired::double end) as false_alarm_rate,
  count(*) filter (where y = 1) as n_positive, count(*) filter (where y = 0) as n_negative
  from (select orig_split, seq_id, max(label) as y, max(cast(prob >= 0.9 as integer)) as fired, max(case when r = 1 then label end) as top
    from (select *, row_number() over (partition by seq_id order by prob desc, pos) as r from study) group by 1, 2) group by 1"""


@R.add("a7_sequence_metrics", f"with {STUDY} {SEQ_METRICS}", "top1_precision detection_rate false_alarm_rate")
def a7(spark, d):
    return metrics.sequence_metrics(study(spark, d), F.lit(0.9), ["orig_split"])


for _m in metrics.OBJECTIVES:
    @R.add(f"a8_pick_threshold_{_m}", f"with {STUDY} {best_sql('study', 'orig_split', _m)}", f"threshold {_m}")
    def a8(spark, d, m=_m):
        return metrics.pick_threshold(study(spark, d), ["orig_split"], m)


@R.add("a9_evaluate_all", f"with {STUDY} select * from ({item_sql('prob >= 0.9', 'study', 'orig_split')}) join ({rank_sql('study', 'orig_split')}) using (orig_split) join ({SEQ_METRICS}) using (orig_split)", " ".join(ITEM) + " auroc auprc top1_precision detection_rate false_alarm_rate")
def a9(spark, d):
    return metrics.evaluate_all(study(spark, d), F.lit(0.9), ["orig_split"])


N_BOOT = 200


def boot_sql(clusters: str, stats: str, keys: str = "") -> str:
    """Replicate sums from clusters(keys, cluster, stats...)."""
    part = f"partition by {keys} " if keys else ""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", ") if k) or "true"
    k = "".join(f"b.{x}, " for x in keys.split(", ") if x)
    sizes = f"select {keys + ', ' if keys else ''}count(*) as m from {clusters}{' group by ' + keys if keys else ''}"
    draws = draw_sql(SEED, "boot", "rep", "slot")
    return f"""select {k}rep, {', '.join(f'sum({s}) as {s}' for s in stats.split())} from (select *, row_number() over ({part}order by seq_id) - 1 as i from {clusters}) b
      join (select *, {draws} % m as i from (select *, unnest(range(m)) as slot from (select *, unnest(range({N_BOOT})) as rep from ({sizes})))) a on {on} and a.i = b.i group by {k}rep"""


@R.add("a10_bootstrap_ci", f"with {STUDY}, clusters as ({counts_sql('prob >= 0.5', 'study', 'orig_split, seq_id')}), reps as ({boot_sql('clusters', 'tp fp fn tn', 'orig_split')}), m as (select orig_split, {SQL_METRICS['macro_f1']} as v from reps where tp + fn > 0 and fp + tn > 0) select orig_split, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high, count(*) as n_used from m group by 1", "low high")
def a10(spark, d):
    return inference.bootstrap_ci(study(spark, d), F.lit(0.5), "macro_f1", N_BOOT, SEED, ["orig_split"])


_PAIRED = [f"cast(count(*) filter (where label = {y} and {'' if up else 'not '}({p} >= 0.5)) as double) as {n}_{s}" for s, p in (("a", "prob"), ("b", "prob_b")) for n, y, up in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False), ("tn", 0, False))]


def _side(s: str, source: str) -> str:
    return f"select rep, {SQL_METRICS['macro_f1']} as v from (select rep, {', '.join(f'{n}_{s} as {n}' for n in ('tp', 'fp', 'fn', 'tn'))} from {source}) where tp + fn > 0 and fp + tn > 0"


@R.add("a11_paired_bootstrap", f"""with {STUDY}, clusters as (select seq_id, {', '.join(_PAIRED)} from study where orig_split = 'test' group by 1),
reps as ({boot_sql('clusters', 'tp_a fp_a fn_a tn_a tp_b fp_b fn_b tn_b')}), d as (select b.v - a.v as d from ({_side('a', 'reps')}) a join ({_side('b', 'reps')}) b using (rep)),
whole as (select -1 as rep, {', '.join(f'sum({n}_{s}) as {n}_{s}' for s in 'ab' for n in ('tp', 'fp', 'fn', 'tn'))} from clusters)
select (select b.v - a.v from ({_side('a', 'whole')}) a join ({_side('b', 'whole')}) b using (rep)) as observed, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high, least(1.0::double, 2 * least(avg(cast(d <= 0 as double)), avg(cast(d >= 0 as double)))) as p_value, count(*) as n_used from d""", "observed low high p_value")
def a11(spark, d):
    s = split_of(spark, d, "test")
    pairs = inference.align_pairs(s.select("seq_id", "pos", "label", "prob"), s.select("seq_id", "pos", F.col("prob_b").alias("prob")), ["seq_id", "pos"])
    return inference.paired_bootstrap(pairs, F.lit(0.5), F.lit(0.5), "macro_f1", N_BOOT, SEED)


@R.add("j9_align_pairs", f"with {STUDY} select seq_id, pos, label, prob as pa, prob_b as pb from study where orig_split = 'test'", "pa pb")
def j9(spark, d):
    s = split_of(spark, d, "test")
    return inference.align_pairs(s.select("seq_id", "pos", "label", "prob"), s.select("seq_id", "pos", F.col("prob_b").alias("prob")), ["seq_id", "pos"])


# --- experiments ----------------------------------------------------------------------------------

FIVE = ["macro_f1", "balanced_accuracy", "f1", "precision", "recall"]


@R.add("a12_summarise_runs", f"with {B.GRID} select condition, model, variant, n_train, {', '.join(f'avg({m}) as {m}_mean, stddev({m}) as {m}_std' for m in FIVE)}, count(*) as runs from runs group by 1, 2, 3, 4", " ".join(f"{m}_{s}" for m in FIVE for s in ("mean", "std")))
def a12(spark, d):
    return experiments.summarise_runs(B.grid_runs(spark, d), FIVE)


@R.add("a13_seed_summary", f"""with {B.GRID}, s as (select condition, count(distinct seed) as n, avg(macro_f1) as mean, coalesce(stddev(macro_f1), 0) as std, min(macro_f1) as min, max(macro_f1) as max, max(macro_f1) - min(macro_f1) as range, array_to_string(list(round(macro_f1, 4)::varchar order by seed), ' ') as shown from runs group by 1 having count(distinct seed) > 1)
select condition, n, mean, std, min, max, range, condition = (select condition from s order by range desc, condition desc limit 1) as widest from s""", "mean std min max range")
def a13(spark, d):
    return experiments.seed_summary(B.grid_runs(spark, d), "macro_f1").drop("values")


PAIRS = "pairs as (select a.seed, a.f1 as dense, b.f1 as sparse, a.f1 - b.f1 as delta from runs a join runs b using (seed) where a.condition = 'k20' and b.condition = 'k1')"


@R.add("j10_pair_by_seed", f"with {B.GRID}, {PAIRS} select * from pairs", "dense sparse delta")
def j10(spark, d):
    return experiments.pair_by_seed(B.grid_runs(spark, d), "f1", "k20", "k1")


@R.add("a14_paired_delta_summary", f"with {B.GRID}, {PAIRS} select count(*) as n, avg(delta) as mean, coalesce(stddev(delta), 0) as std, count(*) filter (where delta > 0) as wins, count(*) filter (where delta < 0) as losses from pairs", "mean std")
def a14(spark, d):
    return experiments.paired_delta_summary(experiments.pair_by_seed(B.grid_runs(spark, d), "f1", "k20", "k1"))


@R.add("j11_pending_runs", f"with {B.GRID} select c as condition, s as seed from (values ('k1'), ('k5'), ('k50')) a(c), (values (0), (3)) b(s) where not exists (select 1 from runs where condition = c and seed = s)")
def j11(spark, d):
    c = spark.createDataFrame([("k1",), ("k5",), ("k50",)], "condition string")
    return experiments.pending(c, spark.createDataFrame([(0,), (3,)], "seed int"), B.grid_runs(spark, d))


ARMS = f"""{STUDY}, arms as (select a.event_type as arm, a.m as val, b.m as test, row_number() over (order by a.event_type)::integer as ord from
  (select event_type, avg(prob) as m from study where orig_split = 'val' group by 1) a join (select event_type, avg(prob) as m from study where orig_split = 'test' group by 1) b using (event_type))"""


def arms(spark, d):
    s = study(spark, d).groupBy(F.col("event_type").alias("arm")).agg(F.avg(F.when(F.col("orig_split") == "val", F.col("prob"))).alias("val"), F.avg(F.when(F.col("orig_split") == "test", F.col("prob"))).alias("test"))
    return s.withColumn("ord", F.row_number().over(Window.orderBy("arm")))


@R.add("a24_selector_quality", f"""with {ARMS}, r as (select *, row_number() over (order by val, arm)::double as rv, row_number() over (order by test, arm)::double as rt from arms)
select count(*) as n, case when count(*) > 3 then corr(val, test) end as pearson, case when count(*) > 3 then corr(rv, rt) end as spearman, arg_max(arm, rv) as best_on_val, arg_max(arm, rt) as best_on_test, max(test) - arg_max(test, rv) as regret from r""", "pearson spearman regret")
def a24(spark, d):
    return experiments.selector_quality(arms(spark, d))


@R.add("a25_pick_winner", f"with {ARMS} select arm, val, test from arms order by val desc, ord limit 1", "val test")
def a25(spark, d):
    return experiments.pick_winner(arms(spark, d), "ord")


@R.add("a26_seed_spread", f"""with {B.GRID}, s as (select condition, avg(f1) as mean, stddev(f1) as std, count(*) as n, max(f1) - min(f1) as range from runs group by 1), b as (select * from s where condition = 'k1')
select s.condition, s.mean, s.std, s.n, s.mean - b.mean as diff, case when sqrt(s.std ** 2 / s.n + b.std ** 2 / b.n) > 0 then (s.mean - b.mean) / sqrt(s.std ** 2 / s.n + b.std ** 2 / b.n) end as t, abs(s.mean - b.mean) > b.range as resolved from s, b where s.condition <> 'k1'""", "mean std diff t")
def a26(spark, d):
    return experiments.seed_spread(B.grid_runs(spark, d), "f1", "k1")


# --- areas, regions, ensembles --------------------------------------------------------------------

REGION = "l_suppkey, cast(case l_returnflag when 'A' then 1 when 'N' then 2 else 0 end as integer) as klass"


def regions(spark, d):
    li = load(spark, d, "lineitem")
    klass = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
    p, g = F.col("l_quantity") > 20, F.col("l_discount") > 0.03
    return li.groupBy("l_suppkey", klass.alias("klass"), p.alias("in_pred"), g.alias("in_truth")).agg(F.count("*").alias("n"))


@R.add("a19_dice_scores", f'select l_suppkey, klass, count(*) filter (where p and g) as "both", count(*) filter (where p) as n_pred, count(*) filter (where g) as n_truth, case when count(*) filter (where g) > 0 then 2.0::double * count(*) filter (where p and g) / (count(*) filter (where p) + count(*) filter (where g)) end as dice from (select {REGION}, l_quantity > 20 as p, l_discount > 0.03 as g from lineitem) group by 1, 2', "dice")
def a19(spark, d):
    return metrics.dice(regions(spark, d), "l_suppkey", "klass")


@R.add("a19_dice_summary", f"""with t as (select {REGION}, l_quantity > 20 as p, l_discount > 0.03 as g from lineitem), d as (select l_suppkey, klass, count(*) filter (where p and g) as b, count(*) filter (where p) as np, count(*) filter (where g) as ng from t group by 1, 2)
select klass, avg(2.0::double * b / (np + ng)) filter (where ng > 0) as mean, stddev(2.0::double * b / (np + ng)) filter (where ng > 0) as std, 2.0::double * sum(b) / (sum(np) + sum(ng)) as pooled from d where klass > 0 group by 1""", "mean std pooled")
def a19b(spark, d):
    one = metrics.dice(regions(spark, d), "l_suppkey", "klass").filter("klass > 0")
    return one.groupBy("klass").agg(F.avg("dice").alias("mean"), F.stddev("dice").alias("std"), (2 * F.sum("both") / (F.sum("n_pred") + F.sum("n_truth"))).alias("pooled"))


@R.add("a20_concentration_ratio", "select l_suppkey, case when sum(l_extendedprice) > 0 and count(*) filter (where l_discount > 0.05) > 0 then (coalesce(sum(l_extendedprice) filter (where l_discount > 0.05), 0) / sum(l_extendedprice)) / (count(*) filter (where l_discount > 0.05) / count(*)) end as ratio from lineitem group by 1", "ratio")
def a20(spark, d):
    return metrics.concentration_ratio(load(spark, d, "lineitem").withColumn("flag", F.col("l_discount") > 0.05), ["l_suppkey"], "l_extendedprice", "flag")


RATIO = "select orig_split, case when event_id % 7 <> 0 then 2 * prob end as v from study"


@R.add("a21_null_safe_summary", f"with {STUDY} select orig_split, count(v) as n, avg(v) as mean, median(v) as median, coalesce(stddev(v), 0) as std, avg(cast(v > 1.5 as double)) as share_above, avg(cast(v < 1.1 as double)) as share_below, count(*) filter (where v is null) as n_null from ({RATIO}) group by 1", "mean median std share_above share_below")
def a21(spark, d):
    return metrics.null_safe_summary(study(spark, d).select("orig_split", F.when(F.col("event_id") % 7 != 0, 2 * F.col("prob")).alias("v")), ["orig_split"], "v")


CAMPAIGN = f"{STUDY}, tagged as (select *, case event_type when 'purchase' then '2021' when 'signup' then '2021' else '2024' end as campaign, cast(pos % 3 = 0 as integer) as y from study where orig_split = 'test'), scored as (select seq_id, pos, campaign, y as label, 'a' as run, prob from tagged union all select seq_id, pos, campaign, y, 'b', prob_b from tagged)"


def scored(spark, d):
    s = split_of(spark, d, "test").withColumn("campaign", F.when(F.col("event_type").isin("purchase", "signup"), "2021").otherwise("2024")).withColumn("label", (F.col("pos") % 3 == 0).cast("int"))
    part = lambda run, p: s.select("seq_id", "pos", "campaign", "label", F.lit(run).alias("run"), F.col(p).alias("prob"))
    return part("a", "prob").unionByName(part("b", "prob_b"))


@R.add("a22_per_group_scores", f"with {CAMPAIGN} select * from ({item_sql('prob >= 0.5', 'scored', 'run, campaign')}) join ({rank_sql('scored', 'run, campaign')}) using (run, campaign) join (select run, campaign, count(distinct seq_id) as clusters from scored group by 1, 2) using (run, campaign)", " ".join(ITEM) + " auroc auprc")
def a22(spark, d):
    s, keys = scored(spark, d), ["run", "campaign"]
    m = metrics.confusion_metrics(metrics.confusion_counts(s, F.col("prob") >= 0.5, keys))
    return m.join(metrics.ranking_metrics(s, keys), keys).join(s.groupBy(*keys).agg(F.countDistinct("seq_id").alias("clusters")), keys)


@R.add("a22_group_gap", f"with {CAMPAIGN}, m as ({rank_sql('scored', 'run, campaign')}), g as (select b.auroc - a.auroc as d from m a join m b using (run) where a.campaign = '2021' and b.campaign = '2024') select avg(d) as mean, median(d) as median, min(d) as min, max(d) as max, count(*) filter (where d > 0) as positive, count(d) as n from g", "mean median min max")
def a22b(spark, d):
    return experiments.group_gap(metrics.ranking_metrics(scored(spark, d), ["run", "campaign"]), "run", "campaign", "auroc", "2021", "2024")


@R.add("a22_gap_ci", f"""with {CAMPAIGN}, clusters as ({counts_sql('prob >= 0.5', "scored where run = 'a'", 'campaign, seq_id')}), reps as ({boot_sql('clusters', 'tp fp fn tn', 'campaign')}),
m as (select campaign, rep, {SQL_METRICS['macro_f1']} as v from reps where tp + fn > 0 and fp + tn > 0), d as (select b.v - a.v as d from m a join m b using (rep) where a.campaign = '2021' and b.campaign = '2024'),
w as (select campaign, {SQL_METRICS['macro_f1']} as v from (select campaign, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from clusters group by 1))
select (select b.v - a.v from w a, w b where a.campaign = '2021' and b.campaign = '2024') as observed, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high, count(*) as n_used from d""", "observed low high")
def a22c(spark, d):
    return inference.gap_ci(scored(spark, d).filter("run = 'a'"), F.lit(0.5), "macro_f1", "campaign", "2021", "2024", N_BOOT, SEED)


@R.add("a23_agreement", f"with {STUDY} select count(*) as n, case when count(*) > 2 then corr(prob, prob_b) end as pearson, case when count(*) > 2 then avg(abs(prob - prob_b)) end as mean_abs_diff from study where event_id % 5 <> 0", "pearson mean_abs_diff")
def a23(spark, d):
    s = study(spark, d).select("prob", F.when(F.col("event_id") % 5 != 0, F.col("prob_b")).alias("prob_b"))
    return metrics.agreement(s, "prob", "prob_b")


@R.add("a27_ensemble_average", """with m as (select vec_id, member, i - 1 as klass, cast(embedding[i + 16 * member] as double) as p from embeddings, range(1, 17) a(i), range(4) b(member)), a as (select vec_id, klass, avg(p) as p from m group by 1, 2),
r as (select *, row_number() over (partition by vec_id order by p desc, klass) as r from a) select vec_id, cast(klass as integer) as winner, p from r where r = 1""", "p")
def a27(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "p"))
    return metrics.ensemble_average(e.select("vec_id", (F.col("i") % 16).alias("klass"), F.col("p").cast("double").alias("p")), "vec_id", "klass", "p")


# --- windows and smoothing ------------------------------------------------------------------------


def windows_sql(size: int, stride: int, dilation: int, source: str, seq: str) -> str:
    span = (size - 1) * dilation + 1
    return f"""select {seq}, cast(w as integer) as "window", cast(slot as integer) as slot, cast(least(w + slot * {dilation}, n - 1) as integer) as ordinal, w + slot * {dilation} > n - 1 as is_pad from (
      select {seq}, n, unnest(case when n <= {span} then [0] else list_distinct(list_concat(range(0, n - {span} + 1, {stride}), [n - {span}])) end) as w from (select {seq}, count(*) as n from {source} group by 1)), range({size}) r(slot)"""


@R.add("w9_clip_windows", f"with {STUDY} {windows_sql(16, 8, 1, 'study', 'seq_id')}")
def w9(spark, d):
    return sequence.clip_windows(study(spark, d), 16, 8)


@R.add("w9_clip_windows_dilated", windows_sql(4, 2, 2, "conversations", "conv_id"))
def w9b(spark, d):
    return sequence.clip_windows(load(spark, d, "conversations"), 4, 2, 2, "conv_id", "turn")


@R.add("a28_merge_overlapping", f"""with {STUDY}, w as ({windows_sql(16, 24, 1, 'study', 'seq_id')}), v as (select w.seq_id, w.ordinal, prob + 0.001::double * (w.slot % 4) as prob from w join study s on s.seq_id = w.seq_id and s.pos = w.ordinal where not is_pad and ordinal % 50 <> 7)
select s.seq_id, s.pos, coalesce(avg(v.prob), 0) as prob, count(v.prob) as covers from study s left join v on v.seq_id = s.seq_id and v.ordinal = s.pos group by 1, 2""", "prob")
def a28(spark, d):
    s = study(spark, d)
    w = sequence.clip_windows(s, 16, 24).filter("not is_pad and ordinal % 50 <> 7").withColumnRenamed("ordinal", "pos")
    w = w.join(s.select("seq_id", "pos", "prob"), ["seq_id", "pos"]).withColumn("prob", F.col("prob") + 0.001 * (F.col("slot") % 4))
    return metrics.merge_overlapping(w, s.select("seq_id", "pos"), ["seq_id", "pos"])


@R.add("w1_with_ordinal", f"with {STUDY} select seq_id, event_id, row_number() over (partition by seq_id order by ts, event_id) - 1 as ordinal, count(*) over (partition by seq_id) as n from study")
def w1(spark, d):
    return sequence.with_ordinal(study(spark, d), spread=True).select("seq_id", "event_id", F.col("ordinal").cast("long").alias("ordinal"), "n")


@R.add("w2_transitions", "select conv_id, turn, coalesce(cast(lag(role) over (partition by conv_id order by turn) <> role as integer), 0) as is_transition from conversations")
def w2(spark, d):
    return sequence.transitions(load(spark, d, "conversations"), "role", "conv_id", "turn", spread=True).select("conv_id", "turn", "is_transition")


@R.add("w3_runs", f"with {LAGGED}, r as (select *, sum(is_transition) over (partition by seq_id order by pos) as run from lagged) select seq_id, run::bigint as run, any_value(label) as value, min(pos) as start, max(pos) as \"end\", max(pos) - min(pos) + 1 as length, cast((min(pos) + max(pos)) // 2 as integer) as centre from r group by 1, 2")
def w3(spark, d):
    return sequence.runs(study(spark, d), spread=True)


PADDED = """padded as (select seq_id, pos, n, prob, first(prob) over s as f, last(prob) over s as l from (select *, count(*) over (partition by seq_id) as n from study) window s as (partition by seq_id order by pos rows between unbounded preceding and unbounded following))"""


def window_values(width: int) -> str:
    """The padded window of each item as a list, by a self-join on positions."""
    pad = width // 2
    return f"select p.seq_id, p.pos, list(case when p.pos + o < 0 then p.f when p.pos + o > p.n - 1 then p.l else q.prob end) as v from padded p cross join range(-{pad}, {width - pad}) r(o) left join study q on q.seq_id = p.seq_id and q.pos = p.pos + o group by 1, 2"


for _w in (4, 5):
    @R.add(f"w4_moving_average_{_w}", f"with {STUDY}, {PADDED} select seq_id, pos, list_avg(v) as smoothed from ({window_values(_w)})", "smoothed")
    def w4(spark, d, w=_w):
        return sequence.smooth(study(spark, d), "movavg", w).select("seq_id", "pos", "smoothed")

    @R.add(f"w5_median_filter_{_w}", f"with {STUDY}, {PADDED} select seq_id, pos, list_median(v) as smoothed from ({window_values(_w)})", "smoothed")
    def w5(spark, d, w=_w):
        return sequence.smooth(study(spark, d), "median", w).select("seq_id", "pos", "smoothed")


_L = math.log(0.9 / 0.1)
VITERBI = f"""{STUDY}, z as (select seq_id, pos, ln(q / (1 - q)) as z, count(*) over (partition by seq_id) as n from (select seq_id, pos, greatest(1e-6::double, least(1 - 1e-6::double, prob)) as q from study)),
walk as (select seq_id, pos, n, z as d from z where pos = 0 union all select z.seq_id, z.pos, z.n, greatest(-{_L}::double, least({_L}::double, w.d)) + z.z from walk w join z on z.seq_id = w.seq_id and z.pos = w.pos + 1),
back as (select seq_id, pos, cast(d > 0 as integer) as state from walk where pos = n - 1 union all select w.seq_id, w.pos, case when w.d > {_L}::double then 1 when w.d <= -{_L}::double then 0 else b.state end from back b join walk w on w.seq_id = b.seq_id and w.pos = b.pos - 1)"""


@R.add("w6_viterbi_smooth", f"with recursive {VITERBI} select seq_id, pos, state from back")
def w6(spark, d):
    return sequence.viterbi(study(spark, d).select("seq_id", "pos", "prob"), 0.9).select("seq_id", "pos", "state")


@R.add("w7_smooth_by_sequence", f"with {STUDY}, {PADDED} select seq_id, pos, list_avg(v) as movavg from ({window_values(9)})", "movavg")
def w7(spark, d):
    return sequence.smooth(study(spark, d), "movavg", 9.0, "movavg").select("seq_id", "pos", "movavg")


_FEW = [("none", "none", 1.0), ("movavg_3", "movavg", 3.0), ("median_5", "median", 5.0), ("movavg_9", "movavg", 9.0)]


@R.add("w8_tune_smoother", f"""with {STUDY}, {PADDED}, s as (select 0 as setting, seq_id, pos, prob from study union all select 1, seq_id, pos, list_sum(v) / 3 from ({window_values(3)}) union all select 2, seq_id, pos, list_median(v) from ({window_values(5)}) union all select 3, seq_id, pos, list_sum(v) / 9 from ({window_values(9)})),
j as (select setting, s.prob, t.label from s join study t using (seq_id, pos) where t.orig_split = 'val'), c as ({curve_sql('j', 'setting')})
select ['none', 'movavg_3', 'median_5', 'movavg_9'][setting + 1] as smoother, t as threshold, m as macro_f1 from c order by round(m, 9) desc, setting, k limit 1""", "threshold macro_f1")
def w8(spark, d):
    return inference.tune_smoother(split_of(spark, d, "val"), _FEW)


def walks_sql(stays: list[float]) -> str:
    """CTEs of the walks and states of several probabilities to stay: states(k, seq_id, pos, state), k from 0."""
    limits = ", ".join(f"({k}, {math.log(s / (1 - s))}::double)" for k, s in enumerate(stays))
    return f"""zs as (select seq_id, pos, ln(q / (1 - q)) as z, count(*) over (partition by seq_id) as n from (select seq_id, pos, greatest(1e-6::double, least(1 - 1e-6::double, prob)) as q from study)),
many as (select k, lim, seq_id, pos, n, z as d from zs, (values {limits}) as l(k, lim) where pos = 0 union all select w.k, w.lim, zs.seq_id, zs.pos, zs.n, greatest(-w.lim, least(w.lim, w.d)) + zs.z from many w join zs on zs.seq_id = w.seq_id and zs.pos = w.pos + 1),
states as (select k, seq_id, pos, cast(d > 0 as integer) as state from many where pos = n - 1 union all select w.k, w.seq_id, w.pos, case when w.d > w.lim then 1 when w.d <= -w.lim then 0 else b.state end from states b join many w on w.k = b.k and w.seq_id = b.seq_id and w.pos = b.pos - 1)"""


_WIDTHS, _STAYS = (3, 5, 9, 15, 25), [p for _, kind, p in sequence.SMOOTHERS if kind == "viterbi"]
_SMOOTHED = " union all ".join(
    ["select 0 as setting, seq_id, pos, prob from study"]
    + [f"select {1 + i}, seq_id, pos, list_sum(v) / {w} from ({window_values(w)})" for i, w in enumerate(_WIDTHS)]
    + [f"select {6 + i}, seq_id, pos, list_median(v) from ({window_values(w)})" for i, w in enumerate(_WIDTHS)]
    + ["select 11 + k, seq_id, pos, state::double from states"]
)


@R.add("w8_tune_smoother_full_rows", f"""with recursive {STUDY}, {walks_sql(_STAYS)}, {PADDED}, s as ({_SMOOTHED}),
j as (select setting, s.prob, t.label from s join study t using (seq_id, pos) where t.orig_split = 'val'), c as ({curve_sql('j', 'setting')})
select {[n for n, _, _ in sequence.SMOOTHERS]}[setting + 1] as smoother, t as threshold, m as macro_f1 from c order by round(m, 9) desc, setting, k limit 1""", "threshold macro_f1")
def w8b(spark, d):
    return inference.tune_smoother(split_of(spark, d, "val"))


@R.add("w8_all_settings", f"with recursive {STUDY}, {walks_sql(_STAYS)}, {PADDED}, s as ({_SMOOTHED}) select setting::integer as setting, seq_id, pos, prob as smoothed from s", "smoothed")
def w8c(spark, d):
    columns = [(f"c{i}", kind, parameter) for i, (_, kind, parameter) in enumerate(sequence.SMOOTHERS)]
    wide = sequence.smooth_all(study(spark, d).select("seq_id", "pos", "prob"), columns)
    return wide.selectExpr("seq_id", "pos", f"stack({len(columns)}, {', '.join(f'{i}, {c}' for i, (c, _, _) in enumerate(columns))}) as (setting, smoothed)")


SPLICE = f"""{STUDY}, win as (select seq_id * 1000 + "window" as window_id, seq_id, "window" as start from ({windows_sql(16, 16, 1, "study", "seq_id")}) where slot = 0 and seq_id % 10 < 6),
cand as (select seq_id, any_value(label) as label, cast(seq_id % 4 as integer) as session from study where orig_split = 'train' group by 1),
near as (select seq_id as near, 1 - label as label, session, row_number() over (partition by session, label order by seq_id) - 1 as pick from cand), near_n as (select session, 1 - label as label, count(*) as n_near from cand group by 1, 2),
far as (select seq_id as far, 1 - label as label, row_number() over (partition by label order by seq_id) - 1 as pick_far from cand), far_n as (select 1 - label as label, count(*) as n_far from cand group by 1),
p as (select window_id, w.seq_id, start, c.label, c.session, case when n_near > 0 then {draw_sql(SEED, "near", "window_id")} % n_near end as pick, {draw_sql(SEED, "far", "window_id")} % n_far as pick_far, {draw_sql(SEED, "same", "window_id")} < 3435973836 as same
  from win w join cand c using (seq_id) left join near_n a on a.session = c.session and a.label = c.label left join far_n b on b.label = c.label),
partners as (select window_id, p.seq_id, start, case when same and near is not null then near else far end as partner from p left join near on near.session = p.session and near.label = p.label and near.pick = p.pick left join far on far.label = p.label and far.pick_far = p.pick_far),
plan as (select *, {draw_sql(SEED, "splice", "window_id")} < 2147483648 as spliced, cast(4 + {draw_sql(SEED, "cut", "window_id")} % 9 as integer) as cut, {draw_sql(SEED, "flip", "window_id")} % 2 = 1 as flipped from partners)"""


def splice_inputs(spark, d):
    s = study(spark, d)
    train = s.filter("orig_split = 'train'")
    w = sequence.clip_windows(train, 16, 16).filter("slot = 0").select((F.col("seq_id") * 1000 + F.col("window")).alias("window_id"), "seq_id", F.col("window").alias("start"))
    cand = train.groupBy("seq_id").agg(F.min("label").alias("label"), (F.first("seq_id") % 4).cast("int").alias("session"))
    return sequence.splice_plan(sequence.partner(w.join(cand, "seq_id"), cand, SEED), 16, SEED), train


@R.add("j12_partner_join", f"with {SPLICE} select window_id, seq_id, partner from partners")
def j12(spark, d):
    return splice_inputs(spark, d)[0].select("window_id", "seq_id", "partner")


@R.add("w10_splice_windows", f"""with {SPLICE}, sizes as (select seq_id, count(*)::integer as n from study group by 1), x as (select plan.*, a.n, b.n as m, slot, slot < cut as lead from plan join sizes a using (seq_id) left join sizes b on b.seq_id = partner, range(16) r(slot)),
y as (select *, spliced and partner is not null and lead = flipped as from_partner, case when lead then cut else 16 - cut end as part, case when lead then slot else slot - cut end as place from x),
z as (select *, case when from_partner then m else n end as len from y),
o as (select *, cast({draw_sql(SEED, "offset", "window_id", "cast(lead as varchar)")} % (greatest(0, len - part) + 1) as integer) as off from z)
select window_id, cast(slot as integer) as slot, case when from_partner then partner else seq_id end as source, cast(case when not spliced or partner is null then least(start + slot, n - 1) when lead then off + greatest(0, place - greatest(0, part - len)) else off + least(place, len - 1) end as integer) as source_pos from o""")
def w10(spark, d):
    plan, train = splice_inputs(spark, d)
    return sequence.spliced_windows(plan, train, 16, SEED)


@R.add("w11_session_ids", "select event_id, (sum(f) over (partition by user_id order by ts, event_id))::bigint as session from (select *, coalesce(cast(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 28800000000 as integer), 0) as f from events)")
def w11(spark, d):
    return sequence.session_ids(load(spark, d, "events"), 8 * 3600, ["user_id"]).select("event_id", "session")


EXAMS = f"""{STUDY}, timed as (select *, sum(f) over (order by ts, event_id) as session from (select *, coalesce(cast(epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id) >= 600000000 as integer), 0) as f from study where event_type not in ('purchase', 'signup'))),
exams as (select event_id, 'session' || cast(session + 1 as bigint) as exam from timed union all select event_id, cast(seq_id as varchar) from study where event_type in ('purchase', 'signup'))"""


def examined(s):
    """Rows of one campaign are named by user and item number, those of the other lie on one time line."""
    named = F.concat(F.col("seq_id").cast("string"), F.lit("I"), (F.col("pos") % 6 + 1).cast("string"))
    return sequence.exam_ids(s.withColumn("_name", named), 600, ~F.col("event_type").isin("purchase", "signup"), "_name").drop("_name")


@R.add("w11_exam_ids", f"with {EXAMS} select event_id, exam from exams")
def w11b(spark, d):
    return examined(study(spark, d)).select("event_id", "exam")


@R.add("w11_global_sessions", "select event_id, (sum(f) over (order by ts, event_id))::bigint as session from (select *, coalesce(cast(epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id) >= 600000000 as integer), 0) as f from events)")
def w11c(spark, d):
    return sequence.session_ids(load(spark, d, "events"), 600, []).select("event_id", "session")


@R.add("a22_scores_by_exam", f"""with {EXAMS}, scored as (select study.seq_id, exam, case when event_type in ('purchase', 'signup') then '2021' else '2024' end as campaign, cast(pos % 3 = 0 as integer) as label, run, case run when 'a' then prob else prob_b end as prob from study join exams using (event_id), (values ('a'), ('b')) r(run) where orig_split = 'test'),
clusters as ({counts_sql('prob >= 0.5', '(select run, campaign, exam as seq_id, label, prob from scored)', 'run, campaign, seq_id')}), reps as ({boot_sql('clusters', 'tp fp fn tn', 'run, campaign')}),
ci as (select run, campaign, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high from (select run, campaign, {SQL_METRICS['macro_f1']} as v from reps where tp + fn > 0 and fp + tn > 0) group by 1, 2)
select * from ({item_sql('prob >= 0.5', 'scored', 'run, campaign')}) join ({rank_sql('scored', 'run, campaign')}) using (run, campaign) join (select run, campaign, count(distinct seq_id) as clusters, count(distinct exam) as exams from scored group by 1, 2) using (run, campaign) join ci using (run, campaign)""", " ".join(ITEM) + " auroc auprc low high")
def a22d(spark, d):
    s = examined(study(spark, d)).filter("orig_split = 'test'").withColumn("campaign", F.when(F.col("event_type").isin("purchase", "signup"), "2021").otherwise("2024")).withColumn("label", (F.col("pos") % 3 == 0).cast("int"))
    part = lambda run, p: s.select("seq_id", "exam", "campaign", "label", F.lit(run).alias("run"), F.col(p).alias("prob"))
    return experiments.group_scores(part("a", "prob").unionByName(part("b", "prob_b")), F.lit(0.5), ["run", "campaign"], "macro_f1", N_BOOT, SEED, exam="exam")


@R.add("j14_disagreements", f"with {STUDY} select event_id, prob >= 0.6 as first_says, prob_b >= 0.7 as second_says from study where (prob >= 0.6) <> (prob_b >= 0.7)")
def j14b(spark, d):
    s = study(spark, d)
    both = experiments.decisions(s.select("event_id", "prob"), s.select("event_id", F.col("prob_b").alias("prob")), ["event_id"], 0.6, 0.7)
    return both.filter("disagree").select("event_id", "first_says", "second_says")


@R.add("w13_rank_display", "select event_type, mean, row_number() over (order by round(mean, 6) desc, event_type) as rank from (select event_type, avg(value) as mean from events group by 1)", "mean")
def w13(spark, d):
    m = load(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mean", 6).desc(), "event_type")).cast("long")).orderBy("rank")


# --- sampling -------------------------------------------------------------------------------------

TRAIN = f"{STUDY}, train as (select *, count(*) over (partition by seq_id) as n, row_number() over (partition by seq_id order by pos) - 1 as o from study where orig_split = 'train'), every as (select *, count(*) over (partition by seq_id) as n, row_number() over (partition by seq_id order by pos) - 1 as o from study)"


def even_sql(k: int, n: str) -> str:
    if k == 1:
        return f"[{n} // 2]"
    return f"case when {n} <= {k} then range({n}) else list_distinct([cast(round_even(i * (({n} - 1) / {k - 1}.0::double), 0) as bigint) for i in range({k})]) end"


for _k in (1, 5):
    @R.add(f"k1_sample_uniform_{_k}", f"with {TRAIN} select seq_id, pos from every where list_contains({even_sql(_k, 'n')}, o)")
    def k1(spark, d, k=_k):
        return sampling.sample_uniform(study(spark, d), k).select("seq_id", "pos")


RANDOM = f"row_number() over (partition by seq_id order by {draw_sql(SEED, 'random', 'seq_id', 'pos')}, pos)"


@R.add("k2_sample_random", f"with {TRAIN} select seq_id, pos from (select *, {RANDOM} as r from every) where r <= 5")
def k2(spark, d):
    return sampling.sample_random(study(spark, d), 5, SEED).select("seq_id", "pos")


CURATED = f"""{LAGGED}, e as (select *, sum(is_transition) over (partition by seq_id order by pos) as run from lagged), c as (select seq_id, (min(pos) + max(pos)) // 2 as o from e where label = 1 group by seq_id, run),
p as (select seq_id, o from (select *, row_number() over (partition by seq_id order by o) as r from c) where r <= 5), h as (select seq_id, count(*) as have from p group by 1),
neg as (select seq_id, pos as o, row_number() over (partition by seq_id order by pos) - 1 as i, count(*) over (partition by seq_id) as n from study where label = 0),
room as (select distinct neg.seq_id, n, least(5 - coalesce(have, 0), n) as want from neg left join h using (seq_id)),
pick as (select seq_id, unnest(case when want = 1 then [n // 2] else list_distinct([cast(round_even(x * ((n - 1) / (want - 1)::double), 0) as bigint) for x in range(want)]) end) as i from room where want > 0),
chosen as (select seq_id, o from p union select seq_id, o from pick join neg using (seq_id, i))"""


@R.add("k3_sample_curated", f"with {CURATED} select seq_id, cast(o as integer) as pos from chosen")
def k3(spark, d):
    return sampling.sample_curated(study(spark, d), 5).select("seq_id", "pos")


@R.add("k4_sample_per_sequence", f"with {TRAIN} select seq_id, pos from every where list_contains({even_sql(20, 'n')}, o)")
def k4(spark, d):
    return sampling.sample_per_sequence(study(spark, d), 20, "uniform").select("seq_id", "pos")


@R.add("k5_stride_sample", f"with {TRAIN} select seq_id, pos from every where o % 8 = 0")
def k5(spark, d):
    return sampling.stride_sample(study(spark, d), 8).select("seq_id", "pos")


@R.add("k6_match_budget_frames", f"with {TRAIN} select seq_id, pos from train order by {draw_sql(SEED, 'budget', 'seq_id', 'pos')}, seq_id, pos limit 434")
def k6(spark, d):
    return sampling.budget_items(split_of(spark, d, "train"), 434, SEED).select("seq_id", "pos")


def shares_sql(budget: str, keys: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"select {k}seq_id, n, least(n, {budget} - (upto - n))::bigint as take from (select *, sum(n) over ({part}order by {draw_sql(SEED, 'order', 'seq_id')}, seq_id) as upto from (select {k}seq_id, count(*) as n from kinds group by {k}seq_id)) where {budget} - (upto - n) > 0"


CHUNK = f"select t.seq_id, t.pos from train t join shares s using (seq_id) where o >= case when take < s.n then {draw_sql(SEED, 'chunk', 's.seq_id')} % (s.n - take + 1) else 0 end and o < case when take < s.n then {draw_sql(SEED, 'chunk', 's.seq_id')} % (s.n - take + 1) else 0 end + take"


@R.add("w12_cumulative_budget", f"with {TRAIN}, kinds as (select * from train), shares as ({shares_sql('434')}) select * from shares")
def w12(spark, d):
    return sampling.sequence_shares(split_of(spark, d, "train"), 434, SEED)


@R.add("k7_match_budget_videos", f"with {TRAIN}, kinds as (select * from train), shares as ({shares_sql('434')}) {CHUNK}")
def k7(spark, d):
    return sampling.budget_sequences(split_of(spark, d, "train"), 434, SEED).select("seq_id", "pos")


PRIOR = f"{TRAIN}, kinds as (select t.*, kind from train t join (select seq_id, cast(avg(label) > 0.5 as integer) as kind, case when avg(label) > 0.5 then 266 else 168 end as want from train group by 1) using (seq_id)), shares as ({shares_sql('case when kind = 1 then 266 else 168 end', 'kind')})"


@R.add("k8_match_budget_and_prior", f"with {PRIOR} {CHUNK}")
def k8(spark, d):
    return sampling.budget_and_prior(split_of(spark, d, "train"), 434, 0.6129, SEED).select("seq_id", "pos")


@R.add("k9_build_condition", f"with {TRAIN}, kinds as (select * from train where o % 2 = 0), shares as ({shares_sql('217')}), s2 as (select seq_id, pos, row_number() over (partition by seq_id order by pos) - 1 as o from kinds) select seq_id, pos from s2 join shares s using (seq_id) where o >= case when take < s.n then {draw_sql(SEED, 'chunk', 's.seq_id')} % (s.n - take + 1) else 0 end and o < case when take < s.n then {draw_sql(SEED, 'chunk', 's.seq_id')} % (s.n - take + 1) else 0 end + take")
def k9(spark, d):
    return sampling.build_condition(split_of(spark, d, "train"), sampling.Condition("half", stride=2, budget=217, budget_unit="video"), SEED).select("seq_id", "pos")


@R.add("a29_compute_budgets", f"with {TRAIN} select 'sparse_k5' as name, count(*) as size from train where list_contains({even_sql(5, 'n')}, o) union all select 'dense_s8', count(*) from train where o % 8 = 0 union all select 'dense_matched_k5', (select count(*) from train where list_contains({even_sql(5, 'n')}, o)) union all select 'dense_matched_k20', null")
def a29(spark, d):
    wanted = [c for c in sampling.CONDITIONS if c.name in ("sparse_k5", "dense_s8", "dense_matched_k5", "dense_matched_k20")]
    return sampling.compute_budgets(split_of(spark, d, "train"), wanted)


@R.add("k10_balanced_sample", f"with {STUDY} select seq_id, pos, label from (select *, row_number() over (partition by label order by {draw_sql(SEED, 'balanced', 'seq_id', 'pos')}, seq_id, pos) as r from study) where r <= 50")
def k10(spark, d):
    return sampling.balanced_sample(study(spark, d), 100, SEED).select("seq_id", "pos", "label")


@R.add("k11_even_rows", f"with {STUDY}, g as (select seq_id, pos, row_number() over (order by seq_id, pos) - 1 as i, count(*) over () as n from study) select seq_id, pos from g where list_contains([cast(floor(x * (n - 1) / 49) as bigint) for x in range(50)], i)")
def k11(spark, d):
    return sampling.even_rows(study(spark, d), 50).select("seq_id", "pos")


@R.add("k12_first_last_qualifying", "with x as (select vec_id, label, [floor(abs(cast(v as double)) * 400) for v in embedding] as x from embeddings) select label, count(*) as n, case when count(*) >= 2 then min(vec_id) end as first, case when count(*) >= 2 then max(vec_id) end as last from x where list_sum(x) / len(x) >= 40 and len([v for v in x if v > 60]) / len(x) >= 0.22 group by 1")
def k12(spark, d):
    from .ingest_queries import images

    return sampling.first_last(images(spark, d), C.has_content(F.col("x"), 40, 60, 0.22), "label", "vec_id")


@R.add("k15_top1_per_sequence", f"with {STUDY} select seq_id, pos, label, prob from (select *, row_number() over (partition by seq_id order by prob desc, pos) as r from study) where r = 1", "prob")
def k15(spark, d):
    return sampling.top1_per_sequence(study(spark, d))


@R.add("k16_distinct_head", "select distinct l_suppkey, l_linenumber from lineitem order by 1, 2 limit 5")
def k16(spark, d):
    from ..operators.ingest import distinct_head

    return distinct_head(load(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"])


# --- splitting ------------------------------------------------------------------------------------


def official(spark, d):
    return splitting.split_official(study(spark, d), ["train", "val", "test"])


@R.add("k13_split_official", f"with {STUDY} select seq_id, min(orig_split) as split from study group by 1")
def k13(spark, d):
    return official(spark, d)


STRATA = f"""{SEQUENCES}, edges as (select quantile_cont(pos_rate, 0.25) as a, quantile_cont(pos_rate, 0.5) as b, quantile_cont(pos_rate, 0.75) as c from sequences where pos_rate > 0 and pos_rate < 1),
strata as (select s.*, cast(case when pos_rate = 0 then 0 when pos_rate = 1 then 1 else 2 + cast(pos_rate > a as integer) + cast(b > a and pos_rate > b as integer) + cast(c > b and pos_rate > c as integer) end as integer) as stratum from sequences s, edges)"""


@R.add("a30_make_strata", f"with {STRATA} select seq_id, stratum from strata")
def a30(spark, d):
    return splitting.strata(sequence.sequence_table(study(spark, d))).select("seq_id", "stratum")


@R.add("k14_split_regrouped", f"""with {STRATA}, f as (select *, (row_number() over (partition by stratum order by {draw_sql(SEED, 'split', 'seq_id')}, seq_id) - 1) % 5 as fold from strata),
r as (select *, (row_number() over (partition by stratum order by {draw_sql(SEED + 1, 'split', 'seq_id')}, seq_id) - 1) % 4 as fold2 from f where fold <> 0)
select seq_id, 'test' as split from f where fold = 0 union all select seq_id, case when fold2 = 0 then 'val' else 'train' end from r""")
def k14(spark, d):
    return splitting.split_regrouped(sequence.sequence_table(study(spark, d)), SEED)


@R.add("j4_select_split", f"with {STUDY} select seq_id, pos from study where orig_split = 'val'")
def j4(spark, d):
    return splitting.select_split(study(spark, d), official(spark, d), "val").select("seq_id", "pos")


@R.add("j5_assert_disjoint", "select 'shared' as fault, count(distinct user_id) filter (where user_id % 10 = 0) as n from events union all select 'lost', count(distinct user_id) filter (where user_id % 10 = 9) from events union all select 'empty', 1")
def j5(spark, d):
    s = official(spark, d)
    broken = s.unionByName(s.filter("seq_id % 10 = 0").withColumn("split", F.lit("val"))).filter("seq_id % 10 <> 9")
    return splitting.split_faults(broken, s, ["train", "val", "test", "extra"])


@R.add("a18_split_profile", f"with {SEQUENCES} select orig_split as split, count(*) as sequences, sum(n)::bigint as rows, (sum(n_pos) / sum(n))::double as pos_rate, count(*) filter (where regime = 'trimmed') as trimmed, count(*) filter (where regime = 'sweep') as sweep, avg(n_transitions) as transitions_per_sequence, sum(n_transitions) = 0 as no_transitions from sequences group by rollup (orig_split)", "pos_rate transitions_per_sequence")
def a18(spark, d):
    return splitting.split_profile(study(spark, d), official(spark, d))


# --- training history -----------------------------------------------------------------------------

HISTORY = f"{STUDY}, history as (select seq_id as run, pos as epoch, round(prob, 3) as metric from study)"


@R.add("a32_best_epoch", f"""with {HISTORY}, b as (select *, max(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before from history),
f as (select *, max(case when before is null or metric > before then epoch end) over (partition by run order by epoch) as fresh from b), s as (select run, min(epoch) as stop from f where epoch - fresh >= 6 group by 1),
t as (select f.run, epoch, metric, coalesce(stop, (select max(epoch) from f g where g.run = f.run)) as stop from f left join s using (run))
select run, arg_max(epoch, metric * 1e6 - epoch) as best_epoch, max(metric) as best_metric, any_value(stop) as stop_epoch from t where epoch <= stop group by 1""", "best_metric")
def a32(spark, d):
    h = study(spark, d).select(F.col("seq_id").alias("run"), F.col("pos").alias("epoch"), F.round("prob", 3).alias("metric"))
    return metrics.best_epoch(h, ["run"])


# --- extension points -----------------------------------------------------------------------------


@R.add("x2_custom_smoother", f"with {STUDY} select seq_id, pos, avg(prob) over (partition by seq_id order by pos) as smoothed from study", "smoothed")
def x2(spark, d):
    def user_code(pdf):
        pdf = pdf.sort_values("pos")
        return pdf.assign(smoothed=pdf["prob"].expanding().mean())[["seq_id", "pos", "smoothed"]]

    return study(spark, d).select("seq_id", "pos", "prob").groupBy("seq_id").applyInPandas(user_code, "seq_id long, pos int, smoothed double")


@R.add("x3_custom_score_rule", f"with {STUDY} select event_id, greatest(prob, prob_b) as score_max from study", "score_max")
def x3(spark, d):
    return study(spark, d).select("event_id", *C.combined(F.col("prob"), F.col("prob_b"), {"max": F.greatest}))


@R.add("x1_custom_selector", f"with {TRAIN} select seq_id, pos from (select *, row_number() over (partition by seq_id order by prob desc, pos) as r from study) where r <= 3")
def x1(spark, d):
    """A selector of a caller: the k items with the highest scores."""
    top = lambda df, k, seed: df.withColumn("_r", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("prob"), "pos"))).filter(F.col("_r") <= k).drop("_r")
    return sampling.sample_per_sequence(study(spark, d), 3, "top_scores", selectors={"top_scores": top}).select("seq_id", "pos")


@R.add("x4_custom_objective", f"with {STUDY} select orig_split, t as threshold, v as recall_first from (select *, row_number() over (partition by orig_split order by v desc, k) as r from (select orig_split, k, t, case when tp + fn > 0 then tp / (tp + fn) else 0 end + (case when tp + fp > 0 then tp / (tp + fp) else 0 end) / 2 as v from ({counts_sql('prob >= t', f'study, {GRID100}', 'orig_split, k, t')}))) where r = 1", "threshold recall_first")
def x4(spark, d):
    return metrics.pick_threshold(study(spark, d), ["orig_split"], "recall_first", {"recall_first": "recall + precision / 2"})


_ENS = "(values ('low', 0), ('low', 1), ('all', 0), ('all', 1), ('all', 2), ('all', 3)) as n(ensemble, member)"


@R.add("x7_named_ensembles", f"""with m as (select vec_id, member, i - 1 as klass, cast(embedding[i + 16 * member] as double) as p from embeddings, range(1, 17) a(i), range(4) b(member)), a as (select ensemble, vec_id, klass, avg(p) as p from m join {_ENS} using (member) group by all),
r as (select *, row_number() over (partition by ensemble, vec_id order by p desc, klass) as r from a) select ensemble, vec_id, cast(klass as integer) as winner, p from r where r = 1""", "p")
def x7(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "p"))
    arms = e.select("vec_id", F.concat(F.lit("arm"), F.floor(F.col("i") / 16).cast("string")).alias("arm"), (F.col("i") % 16).alias("klass"), F.col("p").cast("double").alias("p"))
    named = experiments.ensemble_members(arms, {"low": ["arm0", "arm1"], "all": ["arm0", "arm1", "arm2", "arm3"], "beyond": ["arm0", "arm9"]})
    best = named.groupBy("ensemble", "vec_id", "klass").agg(F.avg("p").alias("p")).groupBy("ensemble", "vec_id").agg(F.max_by("klass", F.struct(F.col("p"), -F.col("klass"))).alias("winner"), F.max("p").alias("p"))
    return best


@R.add("x7_named_pairs", f"with {B.GRID}, n(dense_name, sparse_name) as (values ('k20', 'k1'), ('k5', 'k1')), p as (select dense_name, sparse_name, a.f1 - b.f1 as delta from n join runs a on a.condition = dense_name join runs b on b.condition = sparse_name and a.seed = b.seed) select dense_name, sparse_name, count(*) as n, avg(delta) as mean, coalesce(stddev(delta), 0) as std, count(*) filter (where delta > 0) as wins, count(*) filter (where delta < 0) as losses from p group by 1, 2", "mean std")
def x7b(spark, d):
    return experiments.pair_deltas(B.grid_runs(spark, d), "f1", [("k20", "k1"), ("k5", "k1")])


# --- the model step -------------------------------------------------------------------------------


def vectors(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"))
    return {s: e.filter((F.col("vec_id") % 10).isin(*m)).withColumnRenamed("embedding", "features") for s, m in (("train", range(6)), ("val", (6, 7)), ("test", (8, 9)))}


@R.add("m1_fit_score_rows")
def m1(spark, d):
    v = vectors(spark, d)
    return model.fit_score(v["train"], v["val"], v["test"]).select("vec_id", "label", "prob", "predicted")


@R.add("m2_run_grid_rows")
def m2(spark, d):
    v = vectors(spark, d)
    build = lambda c, seed: v["train"].filter(draw(seed, "grid", "vec_id") % 100 < (30 if c == "sparse" else 90))
    scored_rows = model.run_grid([(c, s) for c in ("sparse", "dense") for s in (0, 1)], build, v["val"], v["test"])
    return metrics.confusion_metrics(metrics.confusion_counts(scored_rows, F.col("predicted") == 1, ["condition", "seed"]))


RANK_REPS = f"""{STUDY}, placed as (select *, row_number() over (partition by orig_split order by seq_id) - 1 as i from (select distinct orig_split, seq_id from study)),
times as (select orig_split, rep, seq_id, t from (select orig_split, rep, {draw_sql(SEED, "boot", "rep", "slot")} % m as i, count(*) as t from (select *, unnest(range(m)) as slot from (select *, unnest(range({N_BOOT})) as rep from (select orig_split, count(*) as m from placed group by 1))) group by all) join placed using (orig_split, i)),
bins as (select orig_split, rep, prob, sum(case when label = 1 then t else 0 end)::double as pos, sum(case when label <> 1 then t else 0 end)::double as neg from study join times using (orig_split, seq_id) group by all),
cum as (select *, (sum(pos) over w)::double as cp, (sum(neg) over w)::double as cn from bins window w as (partition by orig_split, rep order by prob desc)),
reps as (select orig_split, rep, sum(pos) as p, sum(neg) as n, sum(neg * (cp - 0.5::double * pos)) as area, sum(pos * cp / (cp + cn)) as steps from cum group by 1, 2)"""


@R.add("x5_bootstrap_auprc", f"with {RANK_REPS} select orig_split, quantile_cont(steps / p, 0.025) as low, quantile_cont(steps / p, 0.975) as high, count(*) as n_used from reps where p > 0 and n > 0 group by 1", "low high")
def x5b(spark, d):
    return inference.bootstrap_ci(study(spark, d), F.lit(0.5), "auprc", N_BOOT, SEED, ["orig_split"])


@R.add("x5_bootstrap_auroc_rows", f"with {RANK_REPS} select orig_split, quantile_cont(area / (p * n), 0.025) as low, quantile_cont(area / (p * n), 0.975) as high, count(*) as n_used from reps where p > 0 and n > 0 group by 1", "low high")
def x5(spark, d):
    return inference.bootstrap_ci(study(spark, d), F.lit(0.5), "auroc", N_BOOT, SEED, ["orig_split"])


# --- streams, run over what there is and compared with the batch form in tests ---------------------


def stream_of(spark, batch, name):
    """A batch result as a stream of files in a new shared folder."""
    from ..sources.shared import fresh_path

    path = fresh_path(spark, f"stream-{name}")
    batch.write.parquet(f"{path}/in")
    return spark.readStream.schema(batch.schema).parquet(f"{path}/in"), path


def last_row(batch, **values):
    """A row a year behind the last one, with values for its other columns."""
    late = batch.agg((F.max("ts") + F.expr("interval 365 days")).alias("ts"))
    return late.select(*((F.col("ts") if c == "ts" else F.lit(values[c]).cast(t)).alias(c) for c, t in batch.dtypes))


@R.add("t1_stream_sessions_rows", """with s as (select *, sum(f) over (partition by user_id order by ts, event_id) as session from (select *, coalesce(cast(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 28800000000 as integer), 0) as f from events))
select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts)) as last, count(*) as n from s group by user_id, session""")
def t1(spark, d):
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s, path = stream_of(spark, e, "t1")
    out = causal.drained(causal.stream_sessions(s, 8 * 3600 * 1_000_000), "sessions", path, closing=last_row(e, user_id=-1), source=f"{path}/in")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n")


@R.add("t2_stream_dedupe_rows", "select event_id, epoch_us(ts) as ts from events")
def t2(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    s, path = stream_of(spark, e.unionByName(e.filter("event_id % 3 = 0")), "t2")
    return causal.drained(causal.stream_dedupe(s, ["event_id"]), "dedupe", path).select("event_id", F.unix_micros("ts").alias("ts"))


@R.add("t3_stream_transitions", f"with {LAGGED} select seq_id, cast(pos as bigint) as pos, is_transition::bigint as is_transition from lagged")
def t3(spark, d):
    rows = study(spark, d).select("seq_id", F.col("pos").cast("long").alias("pos"), "label", F.col("ts").cast("timestamp").alias("ts"))
    s, path = stream_of(spark, rows, "t3")
    return causal.drained(causal.stream_transitions(s, width="30 days", idle="300 days"), "transitions", path, closing=last_row(rows, seq_id=-1, pos=0, label=0), source=f"{path}/in")


@R.add("t4_stream_trailing_smoother", f"with recursive {VITERBI} select seq_id, cast(pos as bigint) as pos, d as lead from walk", "lead")
def t4(spark, d):
    rows = study(spark, d).select("seq_id", F.col("pos").cast("long").alias("pos"), C.clip_logit(F.col("prob")).alias("logit"), F.col("ts").cast("timestamp").alias("ts"))
    s, path = stream_of(spark, rows, "t4")
    return causal.drained(causal.stream_walk(s, math.log(0.9 / 0.1), width="30 days", idle="300 days"), "walk", path, closing=last_row(rows, seq_id=-1, pos=0, logit=0.0), source=f"{path}/in")


@R.add("t5_stream_detection_alarm_rows", f"with {STUDY} select seq_id as user_id, epoch_us(date_trunc('day', ts)) as start, count(*) as hits from study where prob >= 0.8 group by all")
def t5(spark, d):
    e = study(spark, d).select(F.col("seq_id").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "prob")
    s, path = stream_of(spark, e, "t5")
    out = causal.drained(causal.stream_alarms(s, 0.8), "alarms", path, closing=last_row(e, user_id=-1, prob=1.0), source=f"{path}/in")
    return out.select("user_id", F.unix_micros("start").alias("start"), "hits")


# --- flagship -------------------------------------------------------------------------------------


def flagship(spark, d):
    """A threshold tuned on validation, frozen, and measured on the test split by item and by sequence."""
    chosen = metrics.pick_threshold(split_of(spark, d, "val"), [])
    test = split_of(spark, d, "test").crossJoin(F.broadcast(chosen.select("threshold")))
    return metrics.evaluate_all(test, F.col("threshold"), ["orig_split", "threshold"])


R.add("flagship_frozen_threshold", f"""with {STUDY}, best as (select t as threshold from ({curve_sql("study where orig_split = 'val'", 'orig_split').replace("where orig_split = 'val', ", ", ").replace("group by", "where orig_split = 'val' group by")}) order by m desc, k limit 1),
tt as (select study.*, threshold from study, best where orig_split = 'test')
select * from ({item_sql('prob >= threshold', 'tt', 'orig_split, threshold')}) join ({rank_sql('tt', 'orig_split, threshold')}) using (orig_split, threshold) join ({SEQ_METRICS.replace('prob >= 0.9', 'prob >= (select threshold from best)')}) using (orig_split)""", " ".join(ITEM) + " threshold auroc auprc top1_precision detection_rate false_alarm_rate")(flagship)
