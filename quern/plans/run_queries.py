"""Whole runs, reports and their rendered rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, signals, texts
from ..operators import bootstrap, constraints, graph, joins, metrics, projections, scoring, selection
from ..operators.releases import validated
from ..operators.summaries import broken_links, distinct_total, split_report
from ..sources import records, sinks
from ..storage import shared_dir
from ..streaming import ledger
from . import runs
from .base import cohort, cohort_sql, rounded, table
from .catalog import query
from .metric_queries import CONFUSION, RANKS, RATES, _wilson_sql
from .relational_queries import rank_sql

C = cohort_sql()
O = cohort_sql("other", "260906")
ALL = f"{C}, one as (select 0 as g, * from cohort where prob is not null)"


def _point_sql(threshold: str) -> str:
    return f"""with {ALL}, {RANKS.format(g='g', t='one')}, a as (select g, {CONFUSION.format(t=threshold)} from one group by g)
select n, n_pos, n_neg, tp, tn, fp, fn, {RATES}, round(auroc, 9) as auroc, round(auprc, 9) as auprc from a join rk using (g)"""


# --- runs and their verification --------------------------------------------------------

@query("o01_o02_detector_run", _point_sql("0.5"))
def o01(spark, sf):
    return rounded(runs.detector_report(cohort(spark, sf).select("track_id", "source", "label", "prob"))["overall"])


@query("o02_detector_gates", f"""with {C}, s as (select source, min_by(label, track_id) filter (prob is not null) as label, avg((prob >= 0.5)::int) filter (prob is not null) as v from cohort group by source)
select source, round(v, 9) as value, case when label = 0 then 0.05 else 0.9 end::double as "limit" from s where (label = 0 and v > 0.05) or (label = 1 and v < 0.9)""")
def o02(spark, sf):
    return rounded(runs.detector_report(cohort(spark, sf).select("track_id", "source", "label", "prob"))["gates"].drop("message"))


@query("m31_fixed_threshold", _point_sql("0.7"))
def m31(spark, sf):
    return rounded(metrics.point_metrics(cohort(spark, sf).where("prob is not null"), 0.7))


@query("m29_checkpoint_report", f"""with {C}, a as (select split, count(prob) as scored, count(*) as attempted, sum((prob >= 0.5 and label = 1)::int)::bigint as "TP", sum((prob >= 0.5 and label = 0)::int)::bigint as "FP" from cohort where lang = 'en' group by split)
select split, scored, attempted, coalesce("TP", 0)::bigint as "TP", coalesce("FP", 0)::bigint as "FP", round(scored / attempted::double, 9) as coverage from a""")
def m29(spark, sf):
    rows = cohort(spark, sf).where("lang = 'en'").withColumn("w", F.lit(1).cast("long"))
    return rounded(bootstrap.metric_rows(rows, ["split"]).select("split", "scored", "attempted", "TP", "FP", "coverage"))


@query("m27_scalar_points", f"""with {C}, a as (select lang, count(*) filter (label = 1 and prob >= 0.5) / nullif(count(prob) filter (label = 1), 0)::double as tpr, count(prob) / count(*)::double as coverage from cohort group by lang)
select lang, 'TPR' as metric, round(tpr, 9) as value from a union all select lang, 'coverage', round(coverage, 9) from a""")
def m27(spark, sf):
    rows = cohort(spark, sf).withColumn("w", F.lit(1).cast("long"))
    return rounded(bootstrap.long_form(bootstrap.metric_rows(rows, ["lang"]), ["lang"], ("TPR", "coverage")))


@query("m33_parity_violations", f"with {C}, {O} select track_id from cohort a join other b using (track_id) where abs(a.prob - b.prob) > 0.25 or (a.prob >= 0.5) <> (b.prob >= 0.5)")
def m33(spark, sf):
    both = joins.common_pairs(cohort(spark, sf), cohort(spark, sf, "260906"), "track_id")
    return metrics.parity(both, "prob", "other", 0.25).where("flip or not within").select("track_id")


@query("o04_independent_verification", f"""with {C}, a as (select source, count(*) filter (label = 1 and prob >= 0.5) / nullif(count(*) filter (label = 1), 0)::double as tpr from cohort where prob is not null group by source)
select source, 'tpr' as field, round(tpr, 9) as value, round(tpr + 0.001, 9) as other from a where source in ('src3', 'src4') and tpr is not null""")
def o04(spark, sf):
    scored = cohort(spark, sf).where("prob is not null")
    one, hit = F.col("label") == 1, F.col("prob") >= 0.5
    again = scored.groupBy("source").agg(F.try_divide(F.count_if(one & hit).cast("double"), F.count_if(one).cast("double")).alias("tpr"))
    again = again.withColumn("tpr", F.col("tpr") + F.when(F.col("source").isin("src3", "src4"), 0.001).otherwise(0.0))
    return rounded(runs.agreement(metrics.point_metrics(scored, 0.5, ["source"]), again, ["source"], ["tpr"]))


@query("o23_verify_run", f"""with {C}, m as (select count(*) as n from cohort where stage = 'missing') select 'neither' as "check", n from m where n > 0 union all select 'report differs', 2 where exists (select 1 from cohort where source = 'src3')""")
def o23(spark, sf):
    rows = cohort(spark, sf)
    report = rows.groupBy("source").agg(F.count("prob").alias("n"))
    wrong = report.withColumn("n", F.col("n") + F.when(F.col("source") == "src3", 1).otherwise(0))
    return runs.verify_run(rows.select("track_id"), rows.where("prob is not null"), rows.where("stage = 'inference'"), wrong, report)


@query("o21_verify_plan", """select 'differs' as "check", count(*) as n from part where p_size = 10 having count(*) > 0 union all select 'family in both roles', count(*) from (select p_brand from part group by p_brand having count(distinct p_size % 2) > 1) having count(*) > 0""")
def o21(spark, sf):
    part = table(spark, sf, "part")
    plan = part.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("family"), F.lit("suno").alias("group"), F.when(F.col("p_size") % 2 == 0, "eval").otherwise("train_pool").alias("role"))
    caps = {"human_jamendo": 10, "human_fma_ood": 10, "co_created": 10, "clean_per_generator": 1 << 30, "transform_per_generator": 10}
    lost = part.where("p_size = 10").select(F.col("p_partkey").cast("string").alias("path"))
    return runs.verify_plan(plan, plan.join(lost, "path", "left_anti"), caps)


@query("x05_resumed_predictions", "select o_orderkey::varchar as path from orders where o_orderkey % 4 <> 0")
def x05(spark, sf):
    path = f"{shared_dir(spark)}/quern-predictions-{uuid.uuid4().hex}"
    todo = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"))
    records.write_lines(todo.where("cast(path as long) % 4 = 0").withColumn("prob", F.lit(0.5)), path)
    done = records.read_ledger(spark, path, T.StructType([T.StructField("path", T.StringType()), T.StructField("prob", T.DoubleType())]))
    return joins.missing_rows(todo, done, "path")


@query("x09_progress", "select count(*) as n, count(*) > 0 as told from events")
def x09(spark, sf):
    from .row_queries import _drain, _event_stream

    said: list[str] = []
    listener = ledger.Progress(said.append, 0.0)
    spark.streams.addListener(listener)
    try:
        n = _drain(spark, _event_stream(spark, sf).select("event_id"), "append").agg(F.count(F.lit(1)).alias("n"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return n.withColumn("told", F.lit(bool(said) and listener.batches > 0))
    finally:
        spark.streams.removeListener(listener)


@query("v01_v02_v03_registered_scorer", "select s_suppkey, round(length(regexp_replace(s_name, '[A-Za-z ]', '', 'g')) / length(s_name)::double, 9) as prob from supplier")
def v01(spark, sf):
    rows = scoring.score_rows(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "text_shape", "s_suppkey", column="s_name")
    return rounded(rows.select("s_suppkey", "prob"))


# --- order, graphs, projections ------------------------------------------------------------

@query("w20_scores_in_order", f"with {C} select track_id, (row_number() over (partition by source order by {rank_sql('track_id')}))::int as ordinal, prob from cohort qualify prob is not null")
def w20(spark, sf):
    rows = cohort(spark, sf)
    manifest = selection.hash_shuffled(rows.select("track_id", "source"), "track_id", hashing.RANK_SEED, ["source"]).withColumnRenamed("place", "ordinal")
    return joins.in_order(rows.where("prob is not null").select("track_id", "prob"), manifest, "track_id")


@query("w22_hash_shuffle", "select o_orderkey, (row_number() over (partition by o_orderpriority order by sha256('42:' || o_orderkey)))::int as place from orders")
def w22(spark, sf):
    return selection.hash_shuffled(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "42", ["o_orderpriority"]).select("o_orderkey", "place")


@query("j18_dependence_edges", """select min(doc_id) over (partition by h) as a, doc_id as b from (select doc_id, sha256(text) as h from documents) qualify a <> b
union select min(doc_id) over (partition by source, n_chars) as a, doc_id as b from documents qualify a <> b""")
def j18(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", hashing.sha256_hex("text").alias("h"), F.concat_ws("/", "source", "n_chars").alias("creator"))
    return graph.shared_value_links(docs, "doc_id", ["h", "creator"])


@query("p29_wide_rates", f"""with {C}, r as (select label, source, round(avg((prob >= 0.5)::int), 9) as rate from cohort where prob is not null group by label, source)
select label, max(rate) filter (source = 'src1') as src1, max(rate) filter (source = 'src2') as src2, max(rate) filter (source = 'none') as "none" from r group by label""")
def p29(spark, sf):
    rates = cohort(spark, sf).where("prob is not null").groupBy("label", "source").agg(F.round(F.avg((F.col("prob") >= 0.5).cast("double")), 9).alias("rate"))
    return projections.wide(rates, "label", "source", "rate", ["src1", "src2", "none"])


@query("c29_k12_signal_cache", """select vec_id::varchar as key, 'no value beyond the clip' as rule from embeddings where list_max(list_transform(embedding, lambda x: abs(x::double))) > 0.25 union all select vec_id::varchar, '64 values' from embeddings where vec_id % 10 = 0""")
def c29(spark, sf):
    path = f"{shared_dir(spark)}/quern-signals-{uuid.uuid4().hex}"
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.concat(x, F.array(F.lit(0.0)))).otherwise(x).alias("x"))
    rows.write.parquet(path)
    return constraints.violations(spark.read.schema(rows.schema).parquet(path), "vec_id", signals.cache_rules("x", 64, 0.25))


# --- rendered rows ----------------------------------------------------------------------

RATE = f"a as (select source, count(*) as n, count(*) filter (prob >= 0.5) as k from cohort where label = 0 and prob is not null group by source), w as (select source, n, k, {_wilson_sql('k', 'n')} from a)"


def _rates(spark, sf):
    return metrics.rate_block(cohort(spark, sf).where("label = 0 and prob is not null"), F.col("prob") >= 0.5, ["source"])


@query("z01_z05_z06_rate_rows", f"with {C}, {RATE} select '| ' || source || ' | ' || n || ' | ' || printf('%.1f%% [%.1f, %.1f]', 100 * k / n::double, 100 * lower, 100 * upper) || ' |' as line from w")
def z06(spark, sf):
    return _rates(spark, sf).select(texts.table_row(F.col("source"), F.col("n").cast("string"), texts.interval_text(F.col("rate"), F.col("lower"), F.col("upper"))).alias("line"))


@query("z09_z12_z13_z14_tex_rows", f"with {C}, {RATE} select 'set\\_' || source || ' & ' || n || ' & ' || printf('%.3f', k / n::double) || ' \\\\' as line from w")
def z09(spark, sf):
    name = texts.tex_text(projections.source_name(F.col("source")))
    return _rates(spark, sf).select(texts.table_row(name, F.col("n").cast("string"), texts.fixed_text("rate", 3), tex=True).alias("line"))


@query("s37_s49_interval_texts", f"with {C}, {RATE} select source, printf('%.1f%% [%.1f, %.1f]', 100 * k / n::double, 100 * lower, 100 * upper) as text from w")
def s37(spark, sf):
    return _rates(spark, sf).select("source", texts.interval_text(F.col("rate"), F.col("lower"), F.col("upper")).alias("text"))


@query("s38_tex_escapes", r"select p_partkey, replace(replace(replace(replace(p_name || '_50%&' || p_brand, '&', '\&'), '%', '\%'), '_', '\_'), '#', '\#') as text from part")
def s38(spark, sf):
    return table(spark, sf, "part").select("p_partkey", texts.tex_text(F.concat("p_name", F.lit("_50%&"), "p_brand")).alias("text"))


@query("s35_auc_texts", f"with {C}, s as (select source, avg(prob) as m from cohort group by source) select source, coalesce(printf('%.4f', m), '--') as text from s")
def s35(spark, sf):
    return cohort(spark, sf).groupBy("source").agg(F.avg("prob").alias("m")).select("source", texts.fixed_text("m", 4).alias("text"))


@query("z02_comparison_rows", f"""with {C}, {O}, r as (select a.source, avg((a.prob >= 0.5)::int) as x, avg((b.prob >= 0.5)::int) as y from cohort a join other b using (track_id) where a.label = 0 group by a.source)
select '| ' || source || ' | ' || coalesce(case when x > 0.2 then '**' || printf('%.3f', x) || '**' else printf('%.3f', x) end, '--') || ' | ' || coalesce(case when y > 0.2 then '**' || printf('%.3f', y) || '**' else printf('%.3f', y) end, '--') || ' |' as line from r""")
def z02(spark, sf):
    rows = cohort(spark, sf).where("label = 0").select("track_id", "source", "prob").join(cohort(spark, sf, "260906").select("track_id", F.col("prob").alias("q")), "track_id")
    r = rows.groupBy("source").agg(F.avg((F.col("prob") >= 0.5).cast("double")).alias("x"), F.avg((F.col("q") >= 0.5).cast("double")).alias("y"))

    def cell(c: str):
        return F.when(F.col(c) > 0.2, F.concat(F.lit("**"), texts.fixed_text(c, 3), F.lit("**"))).otherwise(texts.fixed_text(c, 3))

    return r.select(texts.table_row(F.col("source"), cell("x"), cell("y")).alias("line"))


@query("z03_z04_z15_curve_points", f"with {C}, g as (select i * 0.005::double as threshold from range(201) t(i)) select round(threshold, 9) as threshold, round(count(*) filter (label = 0 and prob >= threshold) / greatest(count(*) filter (label = 0), 1)::double, 9) as fpr, round(count(*) filter (label = 1 and prob >= threshold) / greatest(count(*) filter (label = 1), 1)::double, 9) as tpr from cohort, g where prob is not null group by threshold")
def z03(spark, sf):
    return rounded(metrics.threshold_sweep(cohort(spark, sf).where("prob is not null")).select("threshold", "fpr", "tpr"))


@query("z07_z10_section_rows", f"""with {C}, s as (select 'primary' as part, prob from cohort where prob is not null union all select 'strict', prob from cohort where prob is not null and toxic = 0)
select part, '| ' || part || ' | ' || count(*) || ' | ' || printf('%.1f%% (%d/%d)', 100.0 * count(*) filter (prob >= 0.5) / count(*), count(*) filter (prob >= 0.5), count(*)) || ' |' as line from s group by part""")
def z07(spark, sf):
    scored = cohort(spark, sf).where("prob is not null")
    both = scored.withColumn("part", F.lit("primary")).unionByName(scored.where("toxic = 0").withColumn("part", F.lit("strict")))
    g = both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob") >= 0.5).alias("k"))
    return g.select("part", texts.table_row(F.col("part"), F.col("n").cast("string"), texts.percent_text(F.col("k"), F.col("n"))).alias("line"))


@query("g08_needed_ancestors", """with recursive r(node) as (select o_orderkey from orders where o_orderkey % 1000 = 7 union select node // 2 from r where node > 0) select node from r""")
def g08(spark, sf):
    orders = table(spark, sf, "orders")
    nodes = spark.range(orders.agg(F.max("o_orderkey")).first()[0] + 1).where("id > 0")
    links = nodes.select(F.floor(F.col("id") / 2).alias("a"), F.col("id").alias("b"))
    return graph.ancestors(links, orders.where("o_orderkey % 1000 = 7").select(F.col("o_orderkey").alias("node")))


@query("v22_counted_once", "select l_suppkey, count(*) as n, sum(m)::bigint as total from (select l_suppkey, l_partkey, max(l_linenumber) as m from lineitem group by all) group by l_suppkey")
def v22(spark, sf):
    return distinct_total(table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", "l_linenumber")


@query("v27_validated_files", "select doc_id, case when doc_id % 3 = 0 and lang <> 'fr' then false else n_chars >= 100 end as ok, doc_id % 3 = 0 and lang <> 'fr' as reused from documents")
def v27(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", hashing.sha256_hex("text").alias("d"))
    cached = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("lang") == "fr", "old").otherwise(F.col("d")).alias("d"), F.lit(False).alias("ok"))
    return validated(docs, cached, "doc_id", "d", F.col("n_chars") >= 100)


@query("o33_broken_links", r"""with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"#?]*)', 1))) as link from pages) select page_id, link from l where length(link) % 2 = 1""")
def o33(spark, sf):
    pages = table(spark, sf, "pages")
    every = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"#?]*)'), 1)).alias("link"))
    return broken_links(pages, "page_id", "html", every.where(F.length("link") % 2 == 0))


@query("o25_primary_and_strict", f"""with {C}, s as (select 'primary' as part, * from cohort where prob is not null union all select 'strict', * from cohort where prob is not null and stage is null and n_chars >= 500),
a as (select part, label, lang, count(*) as n, count(*) filter (case when label = 1 then prob < 0.5 else prob >= 0.5 end) as k from s group by part, label, lang) select part, label, lang, n, k, round(k / n::double, 9) as rate from a""")
def o25(spark, sf):
    scored = cohort(spark, sf).where("prob is not null").withColumn("seen", F.col("toxic") == 1)
    parts = {"primary": scored, "strict": scored.where("n_chars >= 500")}
    out = None
    for name, rows in parts.items():
        one = split_report(rows, "seen", ("lang", "source"), F.col("prob") >= 0.5, F.col("label") == 1).where("split = 'all' and dim_a <> '*' and dim_b = '*'")
        one = one.select(F.lit(name).alias("part"), "label", F.col("dim_a").alias("lang"), "n", "k", "rate")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("k03_text_lines", "select n_nationkey::bigint as at, n_name as line from nation")
def k03(spark, sf):
    path = f"{shared_dir(spark)}/quern-lines-{uuid.uuid4().hex}"
    lines = table(spark, sf, "nation").select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("line"))
    sinks.write_text(lines, path, "at")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", "\\s+$", ""), "\\s*\n")).alias("at", "line")).select(F.col("at").cast("long").alias("at"), "line")
