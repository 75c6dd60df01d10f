"""Bindings, evidence, released rows and checks of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, intervals, texts
from ..operators import bootstrap, constraints, graph, joins, metrics, pairs, projections, selection, similarity, summaries
from . import runs
from .base import cohort, cohort_sql, rounded, table
from .catalog import query
from .metric_queries import CHOSEN, CONFUSION, RANKS, RATES, _wilson_sql
from .relational_queries import rank_sql

C = cohort_sql()
O = cohort_sql("other", "260906")


# --- joins ----------------------------------------------------------------------

@query("j04_pairwise_common", f"with {C}, {O} select a.source, count(*) as n, round(avg(a.prob - b.prob), 9) as mean_difference from cohort a join other b using (track_id) where a.prob is not null and b.prob is not null group by a.source")
def j04(spark, sf):
    both = joins.common_pairs(cohort(spark, sf), cohort(spark, sf, "260906"), "track_id")
    return rounded(both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("prob") - F.col("other")).alias("mean_difference")))


LEDGER = """p as (select o_orderkey::varchar as path, o_custkey as size from orders where o_orderstatus = 'F'),
l as (select o_orderkey::varchar as path, case when o_orderpriority = '1-URGENT' then -1 else o_custkey end as size, sha256(o_orderkey::varchar) as sha256 from orders where o_orderpriority <> '5-LOW')"""


@query("j05_p11_runtime_manifest", f"with {LEDGER} select 'mb_' || substr(sha1(p.path), 1, 16) as track_id, p.path, l.sha256 as audio_sha256 from p join l on p.path = l.path and p.size = l.size")
def j05(spark, sf):
    orders = table(spark, sf, "orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    plan = orders.where("o_orderstatus = 'F'").select(path, F.col("o_custkey").alias("size"))
    ledger = orders.where("o_orderpriority <> '5-LOW'").select(path, F.when(F.col("o_orderpriority") == "1-URGENT", -1).otherwise(F.col("o_custkey")).alias("size"), hashing.sha256_hex("o_orderkey").alias("sha256"))
    return runs.runtime_manifest(plan, ledger)[0].select("track_id", "path", "audio_sha256")


@query("j09_j10_stem_exposure", """with e as (select doc_id, source, n_chars % 500 as stem from documents where lang = 'en'), t as (select doc_id as other, source as other_source, n_chars % 500 as stem from documents where lang <> 'en')
select doc_id, other from e join t using (stem) where source = other_source""")
def j09(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", (F.col("n_chars") % 500).alias("stem"))
    train = docs.where("lang <> 'en'").select(F.col("doc_id").alias("other"), F.col("source").alias("other_source"), "stem")
    return joins.stem_matches(docs.where("lang = 'en'"), train, "stem", F.col("source") != F.col("other_source")).select("doc_id", "other")


@query("j14_c39_digest_checked_join", """with a as (select doc_id as key, sha256(text) as d from documents where lang <> 'fr'), b as (select doc_id as key, case when source = 'src3' then 'x' else sha256(text) end as d from documents where lang <> 'de')
select coalesce(a.key, b.key) as key, case when b.key is null then 'missing' when a.key is null then 'unlisted' else 'changed' end as rule from a full join b on a.key = b.key where a.d is distinct from b.d""")
def j14(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "lang", "source", hashing.sha256_hex("text").alias("d"))
    actual = docs.where("lang <> 'de'").withColumn("d", F.when(F.col("source") == "src3", "x").otherwise(F.col("d")))
    return constraints.unequal_digests(docs.where("lang <> 'fr'"), actual, "key", "d")


@query("j15_s19_preferred_match", """with l as (select l_orderkey, l_partkey, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as p from lineitem)
select l_orderkey, l_partkey from l qualify row_number() over (partition by l_orderkey order by p, l_partkey) = 1""")
def j15(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    links = items.withColumnRenamed("l_returnflag", "name").dropDuplicates(["l_orderkey", "l_partkey", "name"])
    rows = items.select("l_orderkey", "l_partkey").distinct()
    return joins.preferred_match(rows, links, "l_partkey", "l_orderkey", ["R", "A", "N"]).select("l_orderkey", "l_partkey")


@query("j19_f27_binding_outcomes", """select doc_id, case when doc_id % 7 = 0 then 'not_provided' when doc_id % 11 = 0 then 'invalid_local_path' when doc_id % 13 = 0 then 'not_a_file' when n_chars % 5 = 0 then 'size_mismatch'
  when lang = 'fr' then 'hash_mismatch' else 'bound' end as outcome from documents""")
def j19(spark, sf):
    i = F.col("doc_id")
    outcome = constraints.binding_outcome(i % 7 != 0, i % 11 != 0, i % 13 != 0, F.col("n_chars") % 5 != 0, F.col("lang") != "fr")
    return table(spark, sf, "documents").select("doc_id", outcome.alias("outcome"))


@query("j25_u07_cohort_identity", f"with {C}, {O} select count(*) = count(*) filter (b.track_id is not null) as same from cohort a left join other b using (track_id)")
def j25(spark, sf):
    digests = [cohort(spark, sf, m).agg(hashing.set_digest(F.col("track_id")).alias("d")) for m in ("260905", "260906")]
    return digests[0].join(digests[1].withColumnRenamed("d", "e")).select((F.col("d") == F.col("e")).alias("same"))  # one row each


@query("j28_repeat_differences", f"with {C}, {O} select a.lang as kind, count(*) as comparable, round(max(abs(a.prob - b.prob)), 9) as max_abs_difference from cohort a join other b using (track_id) where a.prob is not null and b.prob is not null group by a.lang")
def j28(spark, sf):
    a, b = cohort(spark, sf).select("track_id", F.col("lang").alias("kind"), "prob"), cohort(spark, sf, "260906").select("track_id", F.col("prob").alias("q"))
    return rounded(pairs.repeat_differences(a.join(b, "track_id").withColumn("d", F.col("prob") - F.col("q")), "kind", "d"))


@query("j29_p14_remapped_ids", f"with {C} select 'mb_' || substr(sha1(track_id::varchar), 1, 16) as track_id, stage from cohort where stage is not null")
def j29(spark, sf):
    rows = cohort(spark, sf).where("stage is not null").select("track_id", "stage", F.lit("/x").alias("path"))
    ids = cohort(spark, sf).select("track_id", hashing.short_id("track_id", "mb_", 16, "sha1").alias("public_id"))
    return projections.remapped(rows, ids)


# --- projections -----------------------------------------------------------------

@query("p02_coalesced_evidence", "select doc_id, coalesce(case when doc_id % 2 = 0 then lang end, case when doc_id % 3 = 0 then source end, 'none') as evidence from documents")
def p02(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", projections.evidence((i % 2 == 0, F.col("lang")), (i % 3 == 0, F.col("source")), missing="none").alias("evidence"))


@query("p12_evaluation_view", f"with {C} select track_id, '/data/' || source || '/' || track_id as runtime_path from cohort where split = 'test'")
def p12(spark, sf):
    rows = cohort(spark, sf).withColumn("role", F.when(F.col("split") == "test", "eval").otherwise("train_pool")).withColumn("path", F.concat_ws("/", "source", "track_id"))
    return runs.evaluation_view(rows, "/data/").select("track_id", "runtime_path")


@query("p19_work_items", f"with {C} select track_id, case when split = 'test' then 0 else 1 end as turn from cohort")
def p19(spark, sf):
    rows = cohort(spark, sf)
    parts = [rows.where("split = 'test'").select("track_id", F.lit(0).alias("turn")), rows.where("split <> 'test'").select("track_id", F.lit(1).alias("turn"))]
    return joins.unique_union(parts, ["track_id"])


@query("p21_p22_keyed_fields", f"with {C} select track_id, toxic = 1 as seen, toxic = 1 as seen_modelx from cohort")
def p21(spark, sf):
    rows = cohort(spark, sf).select("track_id", (F.col("toxic") == 1).alias("seen"), F.lit(None).cast("boolean").alias("seen_modelx"))
    return projections.keyed(rows, ["seen"], "modelx")


@query("p23_attached_field", f"with {C} select c.track_id, d.n_chars > 1000 as long from cohort c join documents d on d.doc_id = c.track_id")
def p23(spark, sf):
    field = table(spark, sf, "documents").select(F.col("doc_id").alias("track_id"), (F.col("n_chars") > 1000).alias("long"))
    return joins.attached_field(cohort(spark, sf).select("track_id"), field, "track_id", "long")


@query("p24_transport_cases", "select user_id || '--' || v as id from (select distinct user_id from events), unnest(['float', 'pcm16', 'mp3']) t(v)")
def p24(spark, sf):
    cases = table(spark, sf, "events").select("user_id").distinct()
    return projections.transport_cases(cases, "user_id", ["float", "pcm16", "mp3"]).select("id")


@query("p27_wide_fpr", f"""with {C}, s as (select source, split, round(avg((prob >= 0.5)::int), 9) as r from cohort where prob is not null and label = 0 group by source, split)
select source, max(r) filter (split = 'calibration') as calibration, max(r) filter (split = 'test') as test, max(r) filter (split = 'validation') as validation from s group by source""")
def p27(spark, sf):
    s = cohort(spark, sf).where("prob is not null and label = 0").groupBy("source", "split").agg(F.round(F.avg((F.col("prob") >= 0.5).cast("double")), 9).alias("r"))
    return projections.wide(s, "source", "split", "r", ["calibration", "test", "validation"])


# --- filters ---------------------------------------------------------------------

@query("f07_lossless_eligibility", "select event_id from events where event_type = 'view' and (user_id % 4 = 0 or user_id % 4 = 1)")
def f07(spark, sf):
    k = F.col("user_id") % 4
    codec = F.when(k == 0, F.concat(F.lit("pcm_s"), "user_id")).when(k == 1, "flac").otherwise("mp3")
    return table(spark, sf, "events").where(selection.lossless_eligible(F.col("event_type"), codec, "view")).select("event_id")


@query("f16_audio_names", "select o_orderkey, o_orderkey % 3 <> 0 as audio from orders")
def f16(spark, sf):
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, "x.txt").when(k == 1, "X.WAV").otherwise("y.mp3")
    return table(spark, sf, "orders").select("o_orderkey", texts.is_audio(name).alias("audio"))


@query("f19_disguised_pages", r"select page_id, regexp_matches(lower(ltrim(left(html, 256))), '^(<!doctype html|<html)') as is_page from pages")
def f19(spark, sf):
    return table(spark, sf, "pages").select("page_id", texts.looks_like_page("html").alias("is_page"))


@query("f24_f25_explicit_decisions", f"with {C} select track_id, coalesce(case when toxic = 1 then true end, prob >= 0.5) as called from cohort where prob is not null")
def f25(spark, sf):
    decision = F.when(F.col("toxic") == 1, True)
    return cohort(spark, sf).where("prob is not null").select("track_id", metrics.called("prob", 0.5, decision).alias("called"))


@query("f26_two_conditions", f"with {C}, {O} select track_id, a.prob >= 0.225 and b.prob >= 0.02 as called from cohort a join other b using (track_id) where a.prob is not null and b.prob is not null")
def f26(spark, sf):
    both = joins.common_pairs(cohort(spark, sf), cohort(spark, sf, "260906"), "track_id")
    return both.select("track_id", metrics.two_conditions("prob", "other").alias("called"))


@query("f15_public_payload", r"select doc_id::varchar as key, 'text: e-mail address' as rule from documents where regexp_matches(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def f15(spark, sf):
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), constraints.URL, "")
    return constraints.violations(table(spark, sf, "documents"), "doc_id", {"text: e-mail address": ~clean.rlike(constraints.EMAIL)})


# --- aggregates ----------------------------------------------------------------------

@query("a01_group_sizes", f"with {C} select source, count(*) as n from cohort group by source")
def a01(spark, sf):
    return summaries.group_sizes(cohort(spark, sf), "source")


@query("a19_release_recount", f"with {C}, n as (select count(*) as n, count(distinct track_id) as k, count(*) filter (label not in (0, 1)) as bad from cohort) select n - k + bad as violations, n - k + bad = 0 as ready from n")
def a19(spark, sf):
    rows = cohort(spark, sf)
    repeated = rows.groupBy(F.col("track_id").cast("string").alias("key")).count().where("count > 1").select("key", F.lit("repeated").alias("rule"))
    return constraints.all_pass(repeated, constraints.violations(rows, "track_id", {"label is 0 or 1": F.col("label").isin(0, 1)}))


@query("a25_run_metrics", f"""with {C} select split, source, count(*) as n, count(prob) as scored, count(*) filter (prob >= 0.5) as called, round(count(*) filter (prob >= 0.5) / nullif(count(prob), 0)::double, 9) as rate from cohort group by split, source""")
def a25(spark, sf):
    g = cohort(spark, sf).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), F.count("prob").alias("scored"), F.count_if(F.col("prob") >= 0.5).alias("called"))
    return rounded(g.withColumn("rate", intervals.ratio(F.col("called"), F.col("scored"))))


@query("a26_parity_summary", f"with {C}, {O} select round(max(abs(a.prob - b.prob)), 9) as max_error, count(*) filter ((a.prob >= 0.5) <> (b.prob >= 0.5)) as flips from cohort a join other b using (track_id) where a.prob is not null and b.prob is not null")
def a26(spark, sf):
    a, b = (cohort(spark, sf, m).where("prob is not null").select("track_id", F.col("prob").alias(n)) for m, n in (("260905", "got"), ("260906", "want")))
    p = metrics.parity(a.join(b, "track_id"), "got", "want", 0.1)
    return rounded(p.agg(F.max("abs_error").alias("max_error"), F.count_if("flip").alias("flips")))


@query("a27_duplicate_totals", "with d as (select sha256(text) as h, count(*) as n from documents group by 1 having count(*) > 1) select count(*) as groups, sum(n)::bigint as entries from d")
def a27(spark, sf):
    found = similarity.exact_copies(table(spark, sf, "documents").select("doc_id", hashing.sha256_hex("text").alias("h")), "doc_id", ["h"])
    return found.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("entries"))


@query("a30_w16_smoke_subset", f"with {C} select track_id, source from cohort qualify row_number() over (partition by source order by {rank_sql('track_id')}, track_id) <= 2")
def a30(spark, sf):
    rows = cohort(spark, sf).select("track_id", "source")
    return selection.top_per_group(rows, ["source"], [hashing.rank_key("track_id"), F.col("track_id")], 2)


@query("m11_independent_metrics", f"with {C} select lang, round(count(*) filter (label = 1 and prob >= 0.5) / count(*) filter (label = 1)::double, 9) as tpr, round(count(*) filter (label = 0 and prob >= 0.5) / nullif(count(*) filter (label = 0), 0)::double, 9) as fpr from cohort where prob is not null group by lang")
def m11(spark, sf):
    return rounded(metrics.point_metrics(cohort(spark, sf).where("prob is not null"), 0.5, ["lang"]).select("lang", "tpr", "fpr"))


@query("m12_weighted_auroc", f"""with {C}, w as (select lang, prob, label, (track_id % 4 + 1)::double as w from cohort where prob is not null),
p as (select lang, prob, sum(case when label = 1 then w else 0 end) as p, sum(case when label = 0 then w else 0 end) as n from w group by lang, prob), c as (select *, coalesce(sum(p) over (partition by lang order by prob desc rows between unbounded preceding and 1 preceding), 0) as above from p)
select lang, round(sum(n * (above + p / 2)) / nullif(sum(p) * sum(n), 0), 9) as "AUROC" from c group by lang""")
def m12(spark, sf):
    rows = cohort(spark, sf).where("prob is not null").withColumn("w", (F.col("track_id") % 4 + 1).cast("double"))
    counts = rows.groupBy("lang", "prob").agg(F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0.0)).alias("neg"))
    return rounded(bootstrap.weighted_auroc(counts, ["lang"]))


@query("m15_intervals", """select event_type as metric, round(avg(value), 6) as estimate, round(quantile_cont(value, 0.025), 9) as lower, round(quantile_cont(value, 0.975), 9) as upper, count(value) as finite_replicates, 7 as replicates from events group by event_type""")
def m15(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    out = bootstrap.intervals(e, e.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value")), ["metric"], 7)
    return rounded(out)


@query("m22_subset_f1", f"""with {C}, a as (select count(*) filter (label = 1 and prob >= 0.5) as tp, count(*) filter (label = 0 and prob >= 0.5) as fp, count(*) filter (label = 1 and prob < 0.5) as fn from cohort where prob is not null and source in ('src2', 'src4'))
select tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 9) as f1 from a""")
def m22(spark, sf):
    rows = cohort(spark, sf).where("prob is not null").where(F.col("source").isin("src2", "src4"))
    return rounded(metrics.point_metrics(rows, 0.5).select("tp", "fp", "fn", "f1"))


@query("m28_model_comparison", f"""with {C}, {O}, r as (select '260905' as model, * from cohort union all select '260906', * from other),
a as (select model, split, count(prob) as scored, count(*) as attempted, count(*) filter (label = 1 and prob >= 0.5) as tp, count(*) filter (label = 1 and prob < 0.5) as fn from r group by model, split)
select model, split, scored, attempted, round(tp / nullif(tp + fn, 0)::double, 9) as "TPR" from a""")
def m28(spark, sf):
    both = [cohort(spark, sf, m).withColumn("model", F.lit(m)) for m in ("260905", "260906")]
    rows = both[0].unionByName(both[1]).withColumn("w", F.lit(1).cast("long"))
    return rounded(bootstrap.metric_rows(rows, ["model", "split"]).select("model", "split", "scored", "attempted", "TPR"))


@query("m30_frozen_analysis", f"""with {C}, {O}, r as (select '260905' as model, track_id, split, source, lang as grp, label, prob from cohort union all select '260906', track_id, split, source, lang, label, prob from other),
z as (with {CHOSEN.format(g='model', t='r', w="split = 'calibration'", m=0.05)} select model, 'calibrated' as rule, threshold as t from best union all select distinct model, 'fixed', 0.5::double from r),
s as (select model, rule, t, label, prob, unnest(['split', 'source', 'grp']) as scope, unnest([split, source, grp]) as name from r join z using (model) where prob is not null),
cells as (select *, concat_ws('|', model, rule, scope, name) as cell from s), k as (with {RANKS.format(g='cell', t='cells')} select cell, auroc, auprc from rk),
a as (select cell, model, rule, scope, name, {CONFUSION.format(t='t')} from cells group by all)
select model, rule, scope, name, n, n_pos, n_neg, tp, tn, fp, fn, {RATES}, round(auroc, 9) as auroc, round(auprc, 9) as auprc from a join k using (cell)""")
def m30_frozen(spark, sf):
    both = [cohort(spark, sf, m).withColumn("model", F.lit(m)) for m in ("260905", "260906")]
    rows = both[0].unionByName(both[1]).select("model", "track_id", "split", "source", F.col("lang").alias("grp"), "label", "prob")
    return rounded(runs.frozen_analysis(rows, 0.05))


# --- windows, ids and texts -----------------------------------------------------------

@query("w03_w04_split_ranks", "select doc_id, sha256('salt:' || doc_id) as bytes_rank, sha256('salt:' || source || ':' || doc_id) as split_rank from documents")
def w03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.binary_rank_key(F.col("doc_id").cast("string"), "salt").alias("bytes_rank"), hashing.split_rank("source", "doc_id", "salt").alias("split_rank"))


@query("w08_representatives", f"with d as (select doc_id, sha256(text) as h from documents) select doc_id from d qualify row_number() over (partition by h order by {rank_sql('doc_id')}) = 1")
def w08(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), hashing.sha256_hex("text").alias("label"))
    return graph.representatives(docs).where("representative").select(F.col("key").cast("long").alias("doc_id"))


@query("w14_first_of_groups", f"with {C} select track_id from cohort qualify row_number() over (partition by lang, label order by {rank_sql('track_id')}, track_id) = 1")
def w14(spark, sf):
    return selection.top_per_group(cohort(spark, sf), ["lang", "label"], [hashing.rank_key("track_id"), F.col("track_id")], 1).select("track_id")


@query("w18_preference_sort", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag <> 'R', l_linenumber)::int as place from lineitem")
def w18(spark, sf):
    rows = selection.preference_order(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "place")


@query("s03_s21_s51_short_ids", "select doc_id, 'ab2-' || substr(sha256(doc_id::varchar), 1, 20) as public_id, 'ab2l-' || substr(sha256(source), 1, 20) as lineage, source || ':' || doc_id as entry_key from documents")
def s03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.short_id("doc_id", "ab2-", 20).alias("public_id"), hashing.short_id("source", "ab2l-", 20).alias("lineage"), F.concat_ws(":", "source", "doc_id").alias("entry_key"))


@query("s07_s08_fingerprints", f"with {C} select split, sha256(string_agg(track_id || chr(9) || source || chr(10), '' order by track_id || chr(9) || source)) as digest from cohort group by split")
def s07(spark, sf):
    line = F.concat_ws("\t", F.col("track_id").cast("string"), "source")
    return cohort(spark, sf).groupBy("split").agg(hashing.joined_digest(line, ending="\n").alias("digest"))


@query("s39_s15_names", f"with {C} select track_id, case when toxic = 1 then 'seen' else 'unseen' end as part, 'set_' || lang as name from cohort")
def s39(spark, sf):
    return cohort(spark, sf).select("track_id", projections.part_label(F.col("toxic") == 1).alias("part"), projections.source_name(F.col("lang")).alias("name"))


@query("s42_sequence_tokens", """with f as (select vec_id, list_transform(embedding, lambda x: floor(abs(x)::double * 1000000)::bigint % 4294967296) as v from embeddings)
select vec_id as key, (i - 1)::int as at, ((v[i] & 65535) * 65536 + (v[i + 3] & 65535))::bigint as token from f, unnest(generate_series(1, len(v) - 3)) u(i)
union all select vec_id, (i - 1)::int, (4294967296 + ((v[i] >> 16) & 65535) * 65536 + ((v[i + 3] >> 16) & 65535))::bigint from f, unnest(generate_series(1, len(v) - 3)) u(i)""")
def s42(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000000.0).cast("long") % 4294967296).alias("v"))
    return similarity.sequence_tokens(rows, "vec_id", "v")


@query("s40_interval_text", f"with {C}, s as (select lang, count(*) as n, count(*) filter (prob >= 0.5) as k from cohort where prob is not null and label = 0 group by lang), w as (select lang, n, k, {_wilson_sql('k', 'n')} from s) select lang, printf('%.3f [%.3f, %.3f]', k / n::double, lower, upper) as text from w")
def s40(spark, sf):
    r = metrics.rate_block(cohort(spark, sf).where("prob is not null and label = 0"), F.col("prob") >= 0.5, ["lang"])
    return r.select("lang", F.format_string("%.3f [%.3f, %.3f]", "rate", "lower", "upper").alias("text"))


@query("o19_corpus_plan")
def o19(spark, sf):
    from .relational_queries import _members

    members = _members(spark, sf).select("path", F.lit("file").alias("type"), F.col("id").alias("size"))
    members = members.dropDuplicates(["path"])
    caps = {"human_jamendo": 30, "human_fma_ood": 30, "co_created": 20, "clean_per_generator": 25, "transform_per_generator": 10}
    return runs.corpus_plan(members, caps, [{"magnet": 50}, {"human_jamendo": 50, "human_fma_ood": 50}], 200_000).select("path", "family", "group", "role")


O08_SQL = """with recursive d as (select doc_id::varchar as key, sha256(text) as h, case when doc_id % 5 = 0 then source || '/' || n_chars end as owner from documents),
e as (select distinct a.key as a, b.key as b from d a join d b on a.h = b.h or a.owner = b.owner), r(node, root) as (select key, key from d union select e.b, r.root from r join e on r.node = e.a),
g as (select node as key, min(root) as root from r group by node), l as (select root, 'cluster:' || substr(sha256(string_agg(key, chr(10) order by key)), 1, 24) as label from g group by root)
select key, label from g join l using (root)"""


@query("o08_duplicate_clusters", O08_SQL)
def o08(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", hashing.sha256_hex("text").alias("h"), F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", "source", F.col("n_chars"))).alias("owner"))
    return runs.duplicate_audit(docs, "doc_id", ["h"], owners=["owner"])["clusters"].select("key", "label")
