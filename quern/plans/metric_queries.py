"""Metrics, summaries, intervals and paired views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import bootstrap, metrics, pairs, summaries
from ..operators.running import from_the_top
from .base import LINES_SQL, cohort, cohort_sql, lines, rounded, table
from .catalog import query

C = cohort_sql()
#: Points of a label's distinct scores with totals from the top, as SQL.
RANKS = """cnt as (select {g}, prob, sum((label = 1)::int) as pos, sum((label = 0)::int) as neg from {t} where prob is not null group by {g}, prob),
cum as (select *, sum(pos) over (partition by {g} order by prob desc) as cp, sum(neg) over (partition by {g} order by prob desc) as cn from cnt),
rk as (select {g}, case when sum(pos) > 0 and sum(neg) > 0 then sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg))::double end as auroc,
  case when sum(pos) > 0 then sum(pos * (cp::double / (cp + cn))) / sum(pos) end as auprc from cum group by {g})"""
CONFUSION = """count(*) as n, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg,
  count(*) filter (label = 1 and prob >= {t}) as tp, count(*) filter (label = 0 and prob < {t}) as tn,
  count(*) filter (label = 0 and prob >= {t}) as fp, count(*) filter (label = 1 and prob < {t}) as fn"""
RATES = """round(tp / nullif(tp + fn, 0)::double, 9) as tpr, round(fp / nullif(fp + tn, 0)::double, 9) as fpr,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 9) as f1,
  round((tp / nullif(tp + fn, 0)::double + tn / nullif(tn + fp, 0)::double) / 2, 9) as balanced_accuracy"""


def _points(group: str, source: str, base: str, threshold: str = "0.5") -> str:
    return f"""with {base}, {RANKS.format(g=group, t=source)},
a as (select {group}, {CONFUSION.format(t=threshold)} from {source} where prob is not null group by {group})
select a.{group}, n, n_pos, n_neg, tp, tn, fp, fn, {RATES}, round(auroc, 9) as auroc, round(auprc, 9) as auprc from a join rk on a.{group} = rk.{group}"""


@query("m01_confusion", f"with {C} select split, {CONFUSION.format(t='0.5')} from cohort where prob is not null group by split")
def m01(spark, sf):
    rows = cohort(spark, sf).where("prob is not null")
    one = F.col("label") == 1
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(one).alias("n_pos"), F.count_if(~one).alias("n_neg"), *metrics.confusion(F.col("prob") >= 0.5, F.col("label")))


@query("m02_point_metrics", _points("split", "cohort", C))
def m02(spark, sf):
    return rounded(metrics.point_metrics(cohort(spark, sf).where("prob is not null"), 0.5, ["split"]))


@query("m25_metrics_by_source", _points("source", "cohort", C))
def m25(spark, sf):
    return rounded(metrics.point_metrics(cohort(spark, sf).where("prob is not null"), 0.5, ["source"]))


@query("m26_metrics_by_cohort_group", _points("lang", "cohort", C))
def m26(spark, sf):
    return rounded(metrics.point_metrics(cohort(spark, sf).where("prob is not null"), 0.5, ["lang"]))


@query("m02_point_metrics_lines", _points("source", "lines", LINES_SQL))
def m02_lines(spark, sf):
    return rounded(metrics.point_metrics(lines(spark, sf), 0.5, ["source"]))


@query("m03_failure_as_error", f"""with {C}, a as (select split, count(*) as n_attempted, count(prob) as n_scored, count(*) - count(prob) as n_failed,
  count(*) filter (label = 1 and prob >= 0.5) as tp, count(*) filter (label = 0 and prob < 0.5) as tn,
  count(*) filter (label = 0 and (prob >= 0.5 or prob is null)) as fp, count(*) filter (label = 1 and (prob < 0.5 or prob is null)) as fn from cohort group by split)
select split, n_attempted, n_scored, n_failed, tp, tn, fp, fn, {RATES} from a""")
def m03(spark, sf):
    return rounded(metrics.failure_as_error(cohort(spark, sf), 0.5, groups=["split"]))


SWEEP = """grid as (select i, i * 0.005::double as threshold from range(201) t(i)),
sw as (select {g} threshold, count(*) filter (label = 1 and prob >= threshold) as tp, count(*) filter (label = 0 and prob >= threshold) as fp,
  count(*) filter (label = 1 and prob < threshold) as fn, count(*) filter (label = 0 and prob < threshold) as tn from {t}, grid where prob is not null group by {g} threshold),
s as (select {g} threshold, tp, fp, fn, tn, tp / greatest(tp + fn, 1)::double as tpr, fp / greatest(fp + tn, 1)::double as fpr, tp / greatest(tp + fp, 1)::double as precision,
  2 * (tp / greatest(tp + fp, 1)::double) * (tp / greatest(tp + fn, 1)::double) / greatest(tp / greatest(tp + fp, 1)::double + tp / greatest(tp + fn, 1)::double, 1e-12) as f1 from sw)"""
_SWEPT = "round(threshold, 9) as threshold, tp, fp, fn, tn, round(tpr, 9) as tpr, round(fpr, 9) as fpr, round(precision, 9) as precision, round(f1, 9) as f1"


@query("m04_threshold_sweep", f"with {C}, {SWEEP.format(g='', t='cohort')} select {_SWEPT} from s")
def m04(spark, sf):
    return rounded(metrics.threshold_sweep(cohort(spark, sf).where("prob is not null")))


@query("m04_threshold_sweep_lines", f"with {LINES_SQL}, {SWEEP.format(g='', t='lines')} select {_SWEPT} from s")
def m04_lines(spark, sf):
    return rounded(metrics.threshold_sweep(lines(spark, sf)))


@query("m07_best_f1", f"with {C}, {SWEEP.format(g='split,', t='cohort')} select split, {_SWEPT} from s qualify row_number() over (partition by split order by s.f1 desc, s.threshold) = 1")
def m07(spark, sf):
    return rounded(metrics.best_f1(metrics.threshold_sweep(cohort(spark, sf).where("prob is not null"), ["split"]), ["split"]))


@query("m08_fpr_constrained", f"with {C}, {SWEEP.format(g='split,', t='cohort')} select split, {_SWEPT} from s where s.fpr <= 0.05 qualify row_number() over (partition by split order by s.tpr desc, s.threshold) = 1")
def m08(spark, sf):
    return rounded(metrics.fpr_constrained(metrics.threshold_sweep(cohort(spark, sf).where("prob is not null"), ["split"]), 0.05, ["split"]))


def _auroc_sql(group: str, source: str, base: str) -> str:
    return f"with {base}, {RANKS.format(g=group, t=source)} select {group}, round(auroc, 9) as auroc, round(auprc, 9) as auprc from rk"


@query("m05_m06_rank_metrics", _auroc_sql("source", "cohort", C))
def m05(spark, sf):
    return rounded(metrics.rank_metrics(cohort(spark, sf).where("prob is not null"), ["source"]))


@query("m05_m06_rank_metrics_lines", _auroc_sql("source", "lines", LINES_SQL))
def m05_lines(spark, sf):
    return rounded(metrics.rank_metrics(lines(spark, sf), ["source"]))


CHOSEN = """c as (select {g}, prob, sum((label = 1)::int) as pos, sum((label = 0)::int) as neg from {t} where prob is not null and ({w}) group by {g}, prob),
u as (select {g}, prob, sum(pos) over (partition by {g} order by prob desc) as cp, sum(neg) over (partition by {g} order by prob desc) as cn, sum(pos) over (partition by {g}) as p, sum(neg) over (partition by {g}) as n from c),
f as (select {g}, prob as threshold, cp / nullif(p, 0)::double as tpr, cn / nullif(n, 0)::double as fpr from u
  union all select {g}, nextafter(max(prob), 'inf'::double), 0.0, 0.0 from u group by {g} having max(n) > 0),
best as (select {g}, threshold, tpr, fpr from f where fpr <= {m} + 1e-12 qualify row_number() over (partition by {g} order by tpr desc, threshold) = 1)"""
_BEST = "round(threshold, 9) as threshold, round(tpr, 9) as tpr, round(fpr, 9) as fpr"


@query("m09_choose_threshold", f"with {C}, {CHOSEN.format(g='lang', t='cohort', w='true', m=0.02)} select lang, {_BEST} from best")
def m09(spark, sf):
    return rounded(metrics.choose_threshold(cohort(spark, sf).where("prob is not null"), 0.02, ["lang"]))


@query("m09_choose_threshold_lines", f"with {LINES_SQL}, {CHOSEN.format(g='source', t='lines', w='true', m=0.01)} select source, {_BEST} from best")
def m09_lines(spark, sf):
    return rounded(metrics.choose_threshold(lines(spark, sf), 0.01, ["source"]))


@query("m10_independent_threshold", f"""with {C}, p as (select distinct split, prob as t from cohort where prob is not null),
x as (select p.split, t, count(*) filter (label = 1 and prob >= t) / nullif(count(*) filter (label = 1), 0)::double as tpr, count(*) filter (label = 0 and prob >= t) / nullif(count(*) filter (label = 0), 0)::double as fpr
  from p join cohort c on c.split = p.split and c.prob is not null group by p.split, t)
select split, round(t, 9) as threshold, round(tpr, 9) as tpr, round(fpr, 9) as fpr from x where fpr <= 0.5 + 1e-12 qualify row_number() over (partition by split order by tpr desc, t) = 1""")
def m10(spark, sf):
    return rounded(metrics.choose_threshold(cohort(spark, sf).where("prob is not null"), 0.5, ["split"]))


@query("m30_calibrate_then_test", f"""with {C}, {CHOSEN.format(g='lang', t='cohort', w="split = 'calibration'", m=0.05)},
t as (select c.*, b.threshold from cohort c join best b on c.lang = b.lang where split <> 'calibration' and prob is not null),
a as (select split, {CONFUSION.format(t='threshold')} from t group by split)
select split, n, n_pos, n_neg, tp, tn, fp, fn, {RATES} from a""")
def m30(spark, sf):
    rows = cohort(spark, sf).where("prob is not null")
    chosen = metrics.choose_threshold(rows.where("split = 'calibration'"), 0.05, ["lang"]).select("lang", "threshold")
    held = rows.where("split <> 'calibration'").join(chosen, "lang")
    return rounded(metrics.point_metrics(held, "threshold", ["split"]).drop("auroc", "auprc"))


Z = 1.959964


def _wilson_sql(k: str, n: str, z: float = Z) -> str:
    p, d = f"({k} / {n}::double)", f"(1 + {z * z!r} / {n})"
    centre = f"(({p} + {z * z!r} / (2 * {n}::double)) / {d})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z!r} / (4 * {n}::double * {n})) / {d})"
    return f"round(greatest(0.0, {centre} - {half}), 9) as lower, round(least(1.0, {centre} + {half}), 9) as upper"


@query("m24_a08_rate_block", f"with {C}, a as (select source, count(*) as n, count(*) filter (prob >= 0.5) as k from cohort where label = 0 and prob is not null group by source) select source, n, k, round(k / n::double, 9) as rate, {_wilson_sql('k', 'n')} from a")
def m24(spark, sf):
    return rounded(metrics.rate_block(cohort(spark, sf).where("label = 0 and prob is not null"), F.col("prob") >= 0.5, ["source"]))


SUMMARY = f"""{C}, s as (select source, count(prob) as n, count(*) as attempted, count(*) - count(prob) as failures, min_by(label, track_id) filter (prob is not null) as label, avg(prob) as prob_mean,
  quantile_cont(prob, 0.5) as prob_median, quantile_cont(prob, 0.1) as prob_p10, quantile_cont(prob, 0.9) as prob_p90, avg((prob >= 0.5)::int) filter (prob is not null) as called from cohort group by source)"""
_SUM = "n, attempted, failures, label, round(prob_mean, 9) as prob_mean, round(prob_median, 9) as prob_median, round(prob_p10, 9) as prob_p10, round(prob_p90, 9) as prob_p90"


@query("a02_source_summary", f"with {SUMMARY} select source, {_SUM}, case when label = 1 then round(called, 9) end as tpr, case when label = 0 then round(called, 9) end as fpr from s")
def a02(spark, sf):
    return rounded(summaries.source_summary(cohort(spark, sf), 0.5, order="track_id"))


@query("f06_a14_source_gates", f"""with {SUMMARY} select source, round(called, 9) as value, case when label = 0 then 0.05 else 0.9 end as gate,
  source || ': ' || case when label = 0 then 'real FPR ' else 'AI TPR ' end || printf('%.3f', called) || case when label = 0 then ' > 0.05' else ' < 0.90' end as message
from s where (label = 0 and called > 0.05) or (label = 1 and called < 0.9)""")
def f06(spark, sf):
    found = summaries.source_gates(summaries.source_summary(cohort(spark, sf), 0.5, order="track_id"))
    return rounded(found.withColumnRenamed("limit", "gate"))


@query("a12_j23_regressions", f"""with {SUMMARY}, {cohort_sql('other', '260906')},
b as (select source, avg((prob >= 0.5)::int) filter (prob is not null) as called, min_by(label, track_id) filter (prob is not null) as blabel from other group by source),
d as (select s.source, s.label, case when s.label = 0 then s.called - case when blabel = 0 then b.called end else case when blabel = 1 then b.called end - s.called end as delta, case when s.label = 0 then 0.03 else 0.05 end as allowed from s join b on s.source = b.source)
select source, label, round(delta, 9) as delta, allowed from d where delta > allowed""")
def a12(spark, sf):
    now, then = (summaries.source_summary(cohort(spark, sf, m), 0.5, order="track_id") for m in ("260905", "260906"))
    return rounded(summaries.regressions(now, then))


@query("a22_worst_sources", f"""with {SUMMARY}, w as (select source, case when label = 1 then called end as tpr, case when label = 0 then called end as fpr from s)
select (select round(min(tpr), 9) from w) as min_tpr, (select source from w where tpr is not null order by tpr, source limit 1) as min_tpr_source,
  (select round(max(fpr), 9) from w) as max_fpr, (select source from w where fpr is not null order by fpr desc, source limit 1) as max_fpr_source""")
def a22(spark, sf):
    return rounded(summaries.worst_sources(summaries.source_summary(cohort(spark, sf), 0.5, order="track_id")))


@query("a13_confusion_from_rates", f"""with {C}, s as (select lang, source, label, count(*) as n, avg((prob >= 0.5)::int) as r from cohort where prob is not null group by lang, source, label),
a as (select lang, coalesce(sum(round_even(n * r, 0)::bigint) filter (label = 1), 0)::bigint as tp, coalesce(sum(n - round_even(n * r, 0)::bigint) filter (label = 1), 0)::bigint as fn,
  coalesce(sum(round_even(n * r, 0)::bigint) filter (label = 0), 0)::bigint as fp, coalesce(sum(n - round_even(n * r, 0)::bigint) filter (label = 0), 0)::bigint as tn from s group by lang)
select lang, tp, fn, fp, tn, round(tp / greatest(tp + fp, 1)::double, 9) as precision, round(tp / greatest(tp + fn, 1)::double, 9) as recall,
  round(2 * (tp / greatest(tp + fp, 1)::double) * (tp / greatest(tp + fn, 1)::double) / greatest(tp / greatest(tp + fp, 1)::double + tp / greatest(tp + fn, 1)::double, 1e-12), 9) as f1 from a""")
def a13(spark, sf):
    rows = cohort(spark, sf).where("prob is not null")
    s = rows.groupBy("lang", "source", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prob") >= 0.5).cast("double")).alias("r"))
    s = s.select("*", F.when(F.col("label") == 1, F.col("r")).alias("tpr"), F.when(F.col("label") == 0, F.col("r")).alias("fpr"))
    return rounded(metrics.confusion_from_rates(s, ["lang"]))


@query("a10_coverage", f"""with {C} select source, count(*) as attempted, count(prob) as scored, count(*) filter (stage = 'inference') as failed, count(*) filter (stage = 'missing') as missing,
  round(count(*) filter (stage = 'inference') / count(*)::double, 9) as failure_rate from cohort group by source""")
def a10(spark, sf):
    return rounded(summaries.coverage(cohort(spark, sf), ["source"], F.col("prob").isNotNull(), F.coalesce(F.col("stage") == "inference", F.lit(False))))


@query("a09_split_report", f"""with {C}, r as (select unnest(['all', case when toxic = 1 then 'seen' else 'unseen' end]) as split2, * from cohort where prob is not null),
g as (select split2 as split, label, lang, source, grouping(lang) as ga, grouping(source) as gb, count(*) as n, count(*) filter ((label = 1 and prob < 0.5) or (label = 0 and prob >= 0.5)) as k,
  list_sort(list(prob))[(count(*) // 2)::int + 1] as prob_median from r group by grouping sets ((split2, label), (split2, label, lang), (split2, label, source), (split2, label, lang, source)))
select split, label, case when ga = 1 then '*' else lang end as dim_a, case when gb = 1 then '*' else source end as dim_b, n, k, round(k / n::double, 9) as rate, {_wilson_sql('k', 'n')}, round(prob_median, 9) as prob_median from g""")
def a09(spark, sf):
    rows = cohort(spark, sf).where("prob is not null").withColumn("seen", F.col("toxic") == 1)
    return rounded(summaries.split_report(rows, "seen", ("lang", "source"), F.col("prob") >= 0.5, F.col("label") == 1))


@query("a11_auroc_against_negatives", f"""with {C}, n as (select prob from cohort where label = 0 and prob is not null), p as (select lang, prob from cohort where label = 1 and prob is not null)
select lang as "group", round(avg(case when p.prob > n.prob then 1.0 when p.prob = n.prob then 0.5 else 0.0 end), 9) as auroc from p, n group by lang""")
def a11(spark, sf):
    rows = cohort(spark, sf).where("prob is not null")
    return rounded(summaries.versus_negatives(rows, "lang", F.col("label") == 1, F.col("label") == 0))


@query("a07_seen_counts", f"""with {C}, r as (select *, toxic = 1 as seen, case when split = 'test' then 'eval' else 'train_pool' end as role from cohort)
select source, count(*) as total, count(*) filter (seen) as seen, count(*) filter (not seen) as unseen, count(*) filter (role = 'eval' and seen) as eval_seen, count(*) filter (role = 'eval' and not seen) as eval_unseen,
  count(*) filter (role = 'train_pool' and seen) as train_pool_seen, count(*) filter (role = 'train_pool' and not seen) as train_pool_unseen from r group by source""")
def a07(spark, sf):
    rows = cohort(spark, sf).withColumn("seen", F.col("toxic") == 1).withColumn("role", F.when(F.col("split") == "test", "eval").otherwise("train_pool"))
    return summaries.seen_counts(rows, "source", "seen", "role")


@query("f03_probability_gate", f"""with {C}, p as (select track_id, case when track_id % 7 = 0 then 'nan'::double when track_id % 11 = 0 then prob + 1 else prob end as prob from cohort)
select track_id, coalesce(not isnan(prob) and prob between 0 and 1, false) as ok from p""")
def f03(spark, sf):
    p = F.when(F.col("track_id") % 7 == 0, F.lit(float("nan"))).when(F.col("track_id") % 11 == 0, F.col("prob") + 1).otherwise(F.col("prob"))
    return cohort(spark, sf).select("track_id", metrics.valid_probability(p).alias("ok"))


@query("m32_parity", f"""with {C}, {cohort_sql('other', '260906')} select track_id, round(abs(a.prob - b.prob), 9) as abs_error, (a.prob >= 0.5) <> (b.prob >= 0.5) as flip, abs(a.prob - b.prob) <= 0.1 as within
from cohort a join other b using (track_id) where a.prob is not null and b.prob is not null""")
def m32(spark, sf):
    a, b = (cohort(spark, sf, m).where("prob is not null").select("track_id", F.col("prob").alias(n)) for m, n in (("260905", "got"), ("260906", "want")))
    return rounded(metrics.parity(a.join(b, "track_id"), "got", "want", 0.1).drop("got", "want"))


VIEWS = ["click", "purchase", "view"]


def _views(spark, sf):
    events = table(spark, sf, "events")
    rows = events.where(F.col("event_type").isin(VIEWS)).groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"), F.min_by("value", "event_id").alias("v"))
    rows = rows.withColumn("p", F.floor(F.pmod(F.col("v") * 1000, F.lit(1000.0))) / 1000.0)
    return pairs.view_table(rows, ["user_id"], "event_type", "p", VIEWS)


VIEWS_SQL = """v as (select user_id, event_type, floor(fmod(min_by(value, event_id) * 1000, 1000.0)) / 1000.0 as p from events where event_type in ('click', 'purchase', 'view') group by user_id, event_type),
w as (select user_id, max(p) filter (event_type = 'click') as click, max(p) filter (event_type = 'purchase') as purchase, max(p) filter (event_type = 'view') as view from v group by user_id)"""


@query("p26_a17_view_ranges", f"""with {VIEWS_SQL} select user_id, click, purchase, view, round(case when click is not null and purchase is not null and view is not null then greatest(click, purchase, view) - least(click, purchase, view) end, 9) as range from w""")
def a17(spark, sf):
    return rounded(pairs.view_range(_views(spark, sf), VIEWS))


@query("a15_a16_range_statistics", f"""with {VIEWS_SQL}, r as (select case when click is not null and purchase is not null and view is not null then greatest(click, purchase, view) - least(click, purchase, view) end as range from w)
select count(*) as attempted, count(range) as complete, round(avg(range), 9) as mean, round(quantile_cont(range, 0.5), 9) as median, round(max(range), 9) as max, round(quantile_cont(range, 0.9), 9) as p90 from r""")
def a16(spark, sf):
    return rounded(pairs.range_statistics(pairs.view_range(_views(spark, sf), VIEWS)))


@query("j27_m21_pair_summary", f"""with {VIEWS_SQL}, p as (select 'click' as first, 'view' as second, click as a, view as b from w union all select 'click', 'purchase', click, purchase from w)
select first, second, count(*) as attempted, count(b - a) as complete, round(avg(b - a), 9) as signed_shift, round(avg(abs(b - a)), 9) as absolute_shift,
  round(avg(case when a is not null and b is not null then ((a >= 0.5) <> (b >= 0.5))::int end), 9) as flip_rate, sum(case when a is not null and b is not null then ((a >= 0.5) <> (b >= 0.5))::int end)::bigint as flips from p group by first, second""")
def j27(spark, sf):
    return rounded(pairs.pair_summary(_views(spark, sf), [("click", "view"), ("click", "purchase")]))


@query("j26_four_view_interaction", f"with {VIEWS_SQL} select user_id, round((view - purchase) - (click - purchase), 9) as interaction from w")
def j26(spark, sf):
    return rounded(pairs.interaction(_views(spark, sf), "purchase", "purchase", "click", "view").select("user_id", "interaction"))


def _boot_rows(spark, sf):
    return cohort(spark, sf).where("split = 'test'").withColumn("cell", F.concat_ws("|", "label", "source"))


#: Draws of the stratified cluster bootstrap by hash, as SQL: tables ``test`` and ``weights``.
def _draws_sql(cluster: str, cell: str, some: str = "true") -> str:
    return f"""{C}, test as (select * replace ({cluster} as cluster), {cell} as cell from cohort where split = 'test' and {some}), pc as (select distinct cluster, cell from test),
ce as (select distinct a.cell as a, b.cell as b from pc a join pc b on a.cluster = b.cluster), cr(node, root) as (select a, a from ce union select e.b, r.root from cr r join ce e on r.node = e.a),
st as (select node as cell, min(root) as stratum from cr group by node), cs as (select distinct cluster, stratum from pc join st using (cell)),
pl as (select *, row_number() over (partition by stratum order by substr(sha256(cluster), 1, 3), cluster) - 1 as place, count(*) over (partition by stratum) as n from cs),
dr as (select replicate, stratum, floor((('0x' || substr(sha256('260905:' || replicate || ':' || stratum || ':' || place), 1, 13))::ubigint / 4503599627370496.0::double) * n)::bigint as place from pl, range(2000) as g(replicate)),
weights as (select replicate::int as replicate, cluster, count(*)::int as w from dr join pl using (stratum, place) group by replicate, cluster)"""


DRAWS = _draws_sql("cluster", "label || '|' || source")


def _drawn(spark, sf):
    return bootstrap.bootstrap_weights(_boot_rows(spark, sf), hashed=True)


@query("m18_bootstrap_weights", f"with recursive {DRAWS} select replicate, cluster, w from weights")
def m18(spark, sf):
    return _drawn(spark, sf)


@query("m18_bootstrap_weights_numpy")
def m18_numpy(spark, sf):
    return bootstrap.bootstrap_weights(_boot_rows(spark, sf), hashed=False)


#: Weighted metrics of the groups {g} of a table {t} with a weight w, as SQL: a table ``met``.
WEIGHTED = """x as (select {g}, source, label, sum(case when prob is not null then w else 0 end) as s, sum(case when prob >= 0.5 then w else 0 end) as c, sum(w) as a from {t} group by {g}, source, label),
y as (select {g}, sum(case when label = 1 then c else 0 end) as tp, sum(case when label = 1 then s - c else 0 end) as fn, sum(case when label = 0 then c else 0 end) as fp, sum(case when label = 0 then s - c else 0 end) as tn, sum(s) as s, sum(a) as a,
  case when count(*) filter (label = 1 and s = 0) = 0 then avg(c / nullif(s, 0)::double) filter (label = 1) end as macro_TPR, case when count(*) filter (label = 0 and s = 0) = 0 then avg(c / nullif(s, 0)::double) filter (label = 0) end as macro_FPR from x group by {g}),
k as (select {g}, prob, sum(case when label = 1 then w else 0 end) as p, sum(case when label = 0 then w else 0 end) as n from {t} where prob is not null group by {g}, prob),
z as (select *, sum(p) over (partition by {g} order by prob desc) as cp from k),
auc as (select {g}, sum(n * (cp - p + p / 2.0)) / nullif(sum(p) * sum(n), 0)::double as auroc from z group by {g}),
met as (select y.*, s / nullif(a, 0)::double as coverage, tp / nullif(tp + fp, 0)::double as precision, tp / nullif(tp + fn, 0)::double as tpr, fp / nullif(fp + tn, 0)::double as fpr,
  case when tp + fn > 0 and fp + tn > 0 then 2 * tp / (2 * tp + fp + fn)::double end as f1, case when tp + fn > 0 and fp + tn > 0 then 0.5 * (tp / (tp + fn)::double + 1 - fp / (fp + tn)::double) end as balanced,
  (tp + tn) / nullif(a, 0)::double as correct, auroc from y left join auc using ({g}))"""
_METRIC_NAMES = "['coverage', 'precision', 'TPR', 'FPR', 'specificity', 'F1', 'balanced_accuracy', 'all_attempt_correctness', 'macro_TPR', 'macro_FPR', 'AUROC']"
_METRIC_VALUES = "[coverage, precision, tpr, fpr, 1 - fpr, f1, balanced, correct, macro_TPR, macro_FPR, auroc]"


@query("m13_weighted_metrics", f"""with {C}, t as (select *, (track_id % 5)::bigint as w from cohort where split = 'test'), {WEIGHTED.format(g='lang', t='t')}
select lang, tp::bigint as "TP", fn::bigint as "FN", fp::bigint as "FP", tn::bigint as "TN", s::bigint as scored, a::bigint as attempted, round(coverage, 9) as coverage, round(precision, 9) as precision,
  round(tpr, 9) as "TPR", round(fpr, 9) as "FPR", round(1 - fpr, 9) as specificity, round(f1, 9) as "F1", round(balanced, 9) as balanced_accuracy,
  round(correct, 9) as all_attempt_correctness, round(macro_TPR, 9) as "macro_TPR", round(macro_FPR, 9) as "macro_FPR", round(auroc, 9) as "AUROC" from met""")
def m13(spark, sf):
    rows = cohort(spark, sf).where("split = 'test'").withColumn("w", (F.col("track_id") % 5).cast("long"))
    return rounded(bootstrap.metric_rows(rows, ["lang"]))


_ENDS = "round(quantile_cont(value, 0.025), 9) as lower, round(quantile_cont(value, 0.975), 9) as upper, count(value) as finite_replicates"


@query("m16_bootstrap_summary", f"""with recursive {DRAWS}, t as (select test.*, replicate, w from test join weights using (cluster)), one as (select *, 0 as replicate, 1 as w from test),
drawn as (with {WEIGHTED.format(g='replicate', t='t')} select replicate, unnest({_METRIC_NAMES}) as metric, unnest({_METRIC_VALUES}) as value from met),
point as (with {WEIGHTED.format(g='replicate', t='one')} select unnest({_METRIC_NAMES}) as metric, unnest({_METRIC_VALUES}) as estimate from met), q as (select metric, {_ENDS} from drawn group by metric)
select metric, round(estimate, 9) as estimate, lower, upper, finite_replicates, 2000 as replicates from point join q using (metric)""")
def m16(spark, sf):
    return rounded(bootstrap.summarize(_boot_rows(spark, sf), _drawn(spark, sf), bootstrap.REPLICATES))


@query("m17_paired_difference", f"""with recursive {DRAWS}, {cohort_sql('other', '260906')}, ids as (select track_id from test a join other b using (track_id) where a.prob is not null and b.prob is not null),
pair as (select 'a' as model, track_id, source, label, prob, cluster from test semi join ids using (track_id) union all select 'b', track_id, source, label, prob, cluster from other semi join ids using (track_id)),
t as (select model || '|' || replicate as cell, source, label, prob, w from pair join weights using (cluster)), one as (select model || '|one' as cell, source, label, prob, 1 as w from pair),
drawn as (with {WEIGHTED.format(g='cell', t='t')} select split_part(cell, '|', 1) as model, split_part(cell, '|', 2) as replicate, unnest({_METRIC_NAMES}) as metric, unnest({_METRIC_VALUES}) as value from met),
point as (with {WEIGHTED.format(g='cell', t='one')} select split_part(cell, '|', 1) as model, unnest({_METRIC_NAMES}) as metric, unnest({_METRIC_VALUES}) as value from met),
d as (select metric, replicate, max(value) filter (model = 'a') - max(value) filter (model = 'b') as value from drawn group by metric, replicate), e as (select metric, max(value) filter (model = 'a') - max(value) filter (model = 'b') as estimate from point group by metric),
q as (select metric, {_ENDS} from d group by metric) select metric, round(estimate, 9) as estimate, lower, upper, finite_replicates, 2000 as replicates from e join q using (metric)""")
def m17(spark, sf):
    other = cohort(spark, sf, "260906").where("split = 'test'").withColumn("cell", F.concat_ws("|", "label", "source"))
    return rounded(bootstrap.paired_difference(_boot_rows(spark, sf), other, _drawn(spark, sf), "track_id", bootstrap.REPLICATES))


@query("m20_value_summary", f"""with recursive {DRAWS}, v as (select replicate, sum(prob * w) / nullif(sum(w) filter (prob is not null), 0)::double as value from test join weights using (cluster) group by replicate),
p as (select count(*) as attempted, count(prob) as complete, round(count(prob) / count(*)::double, 9) as coverage, round(avg(prob), 9) as estimate, round(quantile_cont(prob, 0.5), 9) as median, round(quantile_cont(prob, 0.9), 9) as p90, round(max(prob), 9) as max from test),
q as (select {_ENDS} from v) select p.*, q.*, 2000 as replicates from p, q""")
def m20(spark, sf):
    rows = _boot_rows(spark, sf)
    return rounded(bootstrap.summarize_values(rows.withColumn("value", F.col("prob")), _drawn(spark, sf), bootstrap.REPLICATES))


@query("m19_lineage_bootstrap", f"""with recursive {_draws_sql("cluster || '|' || label", 'label::varchar', 'prob is not null')},
s as (select replicate, sum(w * (label = 1 and prob >= 0.5)::int) as tp, sum(w * (label = 1)::int) as p, sum(w * (label = 0 and prob >= 0.5)::int) as fp, sum(w * (label = 0)::int) as n from test join weights using (cluster) group by replicate),
v as (select tp / nullif(p, 0)::double as tpr, fp / nullif(n, 0)::double as fpr, coalesce(2 * tp / nullif(tp + fp + p, 0)::double, 0) as f1 from s),
l as (select unnest(['tpr', 'fpr', 'f1', 'balanced_accuracy']) as metric, unnest([tpr, fpr, f1, (tpr + 1 - fpr) / 2]) as value from v)
select metric, round(quantile_cont(value, 0.025), 9) as lower, round(quantile_cont(value, 0.975), 9) as upper from l group by metric""")
def m19(spark, sf):
    rows = cohort(spark, sf).where("split = 'test' and prob is not null").select(F.concat_ws("|", "cluster", "label").alias("lineage"), "label", "prob")
    return rounded(bootstrap.lineage_intervals(rows, 0.5))


@query("m19_lineage_bootstrap_numpy")
def m19_numpy(spark, sf):
    rows = cohort(spark, sf).where("split = 'test' and prob is not null").select("track_id", F.concat_ws("|", "cluster", "label").alias("lineage"), "label", "prob")
    pdf = bootstrap.lineage_totals(rows, 0.5, "track_id").toPandas().sort_values("first")
    drawn = bootstrap.lineage_bootstrap(pdf, 0.5)
    rows = [(name, *map(float, np.nanquantile(v, [0.025, 0.975]))) for name, v in drawn.items()]
    return spark.createDataFrame(rows, "metric string, lower double, upper double")


@query("z11_range_ecdf", f"""with {VIEWS_SQL}, r as (select round(greatest(click, view) - least(click, view), 9) as range from w where click is not null and view is not null)
select range, count(*) as n, round(sum(count(*)) over (order by range) / sum(count(*)) over ()::double, 9) as share from r group by range""")
def z11(spark, sf):
    ranges = _views(spark, sf).where("click is not null and view is not null").select(F.round(F.greatest("click", "view") - F.least("click", "view"), 9).alias("range"))
    counts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    cum = from_the_top(counts.withColumn("up", 1 - F.col("range")), [], "up", ["n"])
    total = counts.agg(F.sum("n").alias("whole"))
    return rounded(cum.join(F.broadcast(total)).select("range", "n", (F.col("cum_n") / F.col("whole")).alias("share")))
