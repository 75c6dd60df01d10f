"""Joins, sets, selection, graphs, audits and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, texts
from ..operators import catalogue, constraints, graph, joins, projections, selection, similarity, summaries
from ..storage import stage
from .base import cohort, cohort_sql, rounded, table
from .catalog import query

C = cohort_sql()


def rank_sql(key: str, seed: str = "260905") -> str:
    return f"sha256('{seed}:' || ({key})::varchar)"


def _docs(spark, sf):
    return table(spark, sf, "documents")


# --- scans and filters -------------------------------------------------------

@query("c03_keyed_last_wins", "select user_id, max_by(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def c03(spark, sf):
    from ..sources.manifests import keyed_rows

    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("ordinal"))
    return keyed_rows(rows, "user_id").select("user_id", "event_type", "event_id")


@query("f02_f17_source_allow_list", f"with {C} select source, count(*) as n from cohort where source in ('src1', 'src2', 'src3') group by source")
def f02(spark, sf):
    return summaries.group_sizes(joins.of_values(cohort(spark, sf), "source", ["src1", "src2", "src3"]), "source")


@query("f08_first_reason", f"""with {C} select track_id, case when prob is null then 'no_score' when lang <> 'en' then 'language' when n_chars < 500 then 'short' else 'selected' end as reason from cohort""")
def f08(spark, sf):
    rules = [("no_score", F.col("prob").isNull()), ("language", F.col("lang") != "en"), ("short", F.col("n_chars") < 500)]
    return cohort(spark, sf).select("track_id", selection.first_reason(rules, "selected").alias("reason"))


@query("f09_disjoint_families", """with e as (select l_orderkey as f from lineitem where l_returnflag = 'R')
select count(*) as n, sum(l_linenumber)::bigint as s from lineitem where l_orderkey not in (select f from e)""")
def f09(spark, sf):
    items = table(spark, sf, "lineitem")
    held = items.where("l_returnflag = 'R'").select("l_orderkey")
    return joins.disjoint(items, held, "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("long").alias("s"))


@query("f10_private_text", r"""select doc_id::varchar as key, 'text: e-mail address' as rule from documents where regexp_matches(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
union all select doc_id::varchar, 'text: local path' from documents where regexp_matches(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'), '(^|[\s"''])(/Users/|/home/|/mnt/|file://)')""")
def f10(spark, sf):
    return constraints.private_text(_docs(spark, sf), "doc_id", ["text"])


@query("f12_public_url_problems", r"""select page_id, case when url is null or url = '' then null when not starts_with(url, 'https:') then 'not_https' when not regexp_matches(url, '^https://[^/?#]+') then 'no_host'
  when regexp_matches(url, '^https://[^/?#]*@') then 'user_data' when regexp_matches(url, '^[^#]*\?') then 'query' end as problem from pages""")
def f12(spark, sf):
    from ..functions.urls import public_url_problem

    return table(spark, sf, "pages").select("page_id", public_url_problem("url").alias("problem"))


@query("f18_round_robin_share", f"with {C} select track_id, ((row_number() over (partition by source order by track_id)) - 1) % 3 as part from cohort where stage = 'inference'")
def f18(spark, sf):
    rows = cohort(spark, sf).where("stage = 'inference'")
    return selection.share(rows, [F.col("track_id")], 3, ["source"]).select("track_id", F.col("part").cast("long").alias("part"))


# --- joins ----------------------------------------------------------------

@query("j01_scores_with_manifest", f"with {C} select c.track_id, c.prob, d.n_chars from cohort c join documents d on c.track_id = d.doc_id where c.prob is not null")
def j01(spark, sf):
    scores = cohort(spark, sf).where("prob is not null").select("track_id", "prob")
    known, _ = joins.with_unknown(scores, _docs(spark, sf).select(F.col("doc_id").alias("track_id"), "n_chars"), "track_id")
    return known


@query("j02_missing_rows", f"with {C} select track_id, split from cohort where prob is null")
def j02(spark, sf):
    rows = cohort(spark, sf)
    return joins.missing_rows(rows.select("track_id", "split"), rows.where("prob is not null"), "track_id")


@query("j03_u01_common_keys", f"with {C}, {cohort_sql('other', '260906')} select a.track_id from cohort a join other b using (track_id) where a.prob is not null and b.prob is not null")
def j03(spark, sf):
    both = [cohort(spark, sf, m).where("prob is not null").select("track_id", F.lit(m).alias("model")) for m in ("260905", "260906")]
    return joins.common_keys(both[0].unionByName(both[1]), "track_id", "model", 2)


@query("j06_p20_three_way", f"""with {C}, l as (select doc_id as track_id, n_chars / 1000.0 as v from documents where lang <> 'en')
select track_id, case when c.source is null then 'line_only' when l.v is null then 'row_only' else 'both' end as matched from cohort c full join l using (track_id)""")
def j06(spark, sf):
    lines = _docs(spark, sf).where("lang <> 'en'").select(F.col("doc_id").alias("track_id"), (F.col("n_chars") / 1000.0).alias("v"))
    return joins.three_way(cohort(spark, sf).select("track_id", "source"), lines, "track_id").select("track_id", "matched")


@query("j07_content_match", """select l.doc_id, min(d.doc_id) as bound_path, count(d.doc_id) as copies from (select l.doc_id, sha256(d.text) as h from labels l join documents d using (doc_id)) l
join (select doc_id, sha256(text) as h from documents) d on l.h = d.h group by l.doc_id""")
def j07(spark, sf):
    files = _docs(spark, sf).select("doc_id", hashing.sha256_hex("text").alias("h"))
    manifest = files.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return joins.content_match(files, manifest, "h", "doc_id", "doc_id").drop("h")


@query("j08_compare_tables", """with a as (select doc_id, source, lang from documents where lang <> 'fr'), b as (select doc_id, case when source = 'src7' then 'x' else source end as source, lang from documents where lang <> 'de')
select coalesce(a.doc_id, b.doc_id) as key, case when b.doc_id is null then 'left_only' when a.doc_id is null then 'right_only' when a.source <> b.source then 'conflict' else 'equal' end as side,
  case when a.source <> b.source then 'source' else '' end as fields from a full join b on a.doc_id = b.doc_id""")
def j08(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "source", "lang")
    right = docs.where("lang <> 'de'").withColumn("source", F.when(F.col("source") == "src7", "x").otherwise(F.col("source")))
    return joins.compare_tables(docs.where("lang <> 'fr'"), right, "doc_id", ["source", "lang"])


@query("j11_j12_title_matches", """with t as (select p_partkey as id, string_split(p_name, ' ') as w from part), r as (select id, w[1] as title, array_to_string(w[2:], ' ') as artist from t where len(w) > 1)
select p_partkey as key, r.id from (select p_partkey, string_split(p_name, ' ') as w from part), unnest(generate_series(1, len(w) - 1)) u(i), r
where lower(array_to_string(w[1:i], ' - ')) = lower(r.title) and lower(array_to_string(w[i + 1:], ' - ')) = lower(replace(r.artist, ' ', ' - '))""")
def j11(spark, sf):
    part = table(spark, sf, "part")
    ref = part.where(F.size(F.split("p_name", " ")) > 1).select(F.col("p_partkey").alias("id"), F.substring_index("p_name", " ", 1).alias("title"), F.replace(F.regexp_replace("p_name", "^[^ ]* ", ""), F.lit(" "), F.lit(" - ")).alias("artist"))
    rows = part.select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit(" - ")).alias("name"))
    return catalogue.title_matches(rows, ref, "key", "name")


@query("j13_unique_lookup", """with k as (select l_suppkey, l_linenumber, count(distinct l_returnflag) as n, min(l_returnflag) as v from lineitem where l_linestatus = 'F' group by l_suppkey, l_linenumber)
select l.l_orderkey, l.l_linenumber, case when n = 1 then v else 'unknown' end as flag from lineitem l left join k using (l_suppkey, l_linenumber) where l_linestatus = 'O'""")
def j13(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", F.col("l_returnflag").alias("flag"))
    out = joins.unique_lookup(items, ["l_suppkey", "l_linenumber"], "flag", F.col("l_linestatus") == "F", F.col("l_linestatus") == "O")
    return out.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "flag")


@query("j21_override", f"with {C}, {cohort_sql('other', '260906')} select a.track_id, coalesce(b.prob, a.prob) as prob, b.prob is not null as recovered from cohort a join other b using (track_id)")
def j21(spark, sf):
    a, b = cohort(spark, sf), cohort(spark, sf, "260906")
    return joins.override(a, b, "track_id", "prob")


@query("j22_merge_shards", """with a as (select doc_id from documents where lang = 'en' union all select doc_id from documents where source in ('src0', 'src1')), m as (select doc_id from documents where lang in ('en', 'de')),
r as (select doc_id, count(*) as n from a group by doc_id)
select coalesce(m.doc_id, r.doc_id) as key, coalesce(n, 0) as n, case when m.doc_id is null then 'extra' when r.doc_id is null then 'missing' when n > 1 then 'duplicate' else 'ok' end as status from m full join r on m.doc_id = r.doc_id""")
def j22(spark, sf):
    docs = _docs(spark, sf)
    shards = [docs.where("lang = 'en'").select("doc_id"), docs.where("source in ('src0', 'src1')").select("doc_id")]
    return joins.merge_shards(docs.where("lang in ('en', 'de')"), shards, "doc_id")


@query("j24_cohort_restriction", f"with {C} select track_id, source from cohort where track_id in (select doc_id from documents where lang = 'fr')")
def j24(spark, sf):
    ids = _docs(spark, sf).where("lang = 'fr'").select(F.col("doc_id").alias("track_id"))
    return joins.restricted(cohort(spark, sf).select("track_id", "source"), ids, "track_id")[0]


# --- sets -------------------------------------------------------------------

@query("u02_set_difference", """with a as (select distinct l_partkey as k from lineitem where l_quantity > 40), b as (select distinct l_partkey as k from lineitem where l_discount > 0.05)
select case when b.k is null then 'left_only' when a.k is null then 'right_only' else 'common' end as part, count(*) as n from a full join b on a.k = b.k group by 1""")
def u02(spark, sf):
    items = table(spark, sf, "lineitem")
    return joins.set_difference(items.where("l_quantity > 40"), items.where("l_discount > 0.05"), "l_partkey")


@query("u03_u06_unique_union", "select 'a' as part, n_nationkey as id, n_name as name from nation union all select 'b', r_regionkey, r_name from region")
def u03(spark, sf):
    a = table(spark, sf, "nation").select(F.lit("a").alias("part"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, sf, "region").select(F.lit("b").alias("part"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return joins.unique_union([a, b], ["part", "id"])


@query("u05_exact_cover", f"with {C} select 'neither' as problem, count(*) as n from cohort where stage = 'missing' having count(*) > 0")
def u05(spark, sf):
    rows = cohort(spark, sf)
    return joins.exact_cover(rows, rows.where("prob is not null"), rows.where("stage = 'inference'"), "track_id")


@query("u07_s06_ordered_digests", f"with {C} select source, sha256(string_agg(track_id::varchar, chr(10) order by track_id)) as ordered, sha256(string_agg(track_id::varchar, chr(10) order by track_id::varchar)) as sorted from cohort group by source")
def u07(spark, sf):
    return cohort(spark, sf).groupBy("source").agg(hashing.ordered_digest(F.col("track_id"), F.col("track_id")).alias("ordered"), hashing.joined_digest(F.col("track_id")).alias("sorted"))


# --- windows and selection ------------------------------------------------------

@query("w01_w02_drawn_per_source", f"with {C} select track_id, source from cohort qualify row_number() over (partition by source order by {rank_sql('track_id', '42')}, track_id) <= 5")
def w01(spark, sf):
    return selection.drawn_per_source(cohort(spark, sf).select("track_id", "source"), 5)


@query("w05_contiguity", """with r as (select conv_id, turn, length(text) as size, sum((ceil(length(text) / 512.0) * 512)::bigint + case when turn = 2 then 512 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as o from conversations),
x as (select conv_id, turn, coalesce(o, 0)::bigint as off, size from r), y as (select *, coalesce(lag(off + ((size + 511) // 512) * 512) over (partition by conv_id order by off), 0)::bigint as expected_offset from x)
select conv_id, turn, expected_offset from y where off <> expected_offset""")
def w05(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    end = (F.ceil(F.col("size") / 512.0) * 512).cast("long") + F.when(F.col("turn") == 2, 512).otherwise(0)
    rows = rows.withColumn("off", F.coalesce(F.sum(end).over(w), F.lit(0).cast("long")))
    return selection.contiguity(rows, "conv_id", "off", "size").select("conv_id", "turn", "expected_offset")


@query("w06_capped_sample", f"""with t as (select l_orderkey, min('s' || (l_orderkey % 50)) as owner from lineitem group by l_orderkey),
c as (select l_orderkey from t qualify row_number() over (partition by owner order by {rank_sql('l_orderkey')}) <= 2),
l as (select l_orderkey from c order by {rank_sql('l_orderkey')} limit 40) select l_orderkey, l_linenumber from lineitem where l_orderkey in (select l_orderkey from l)""")
def w06(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_orderkey") % 50).alias("owner"))
    return selection.capped_sample(items, 40, "owner", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("w07_quota_selection", f"""with b as (select o_orderkey as id, o_custkey % 300 as owner, case when o_orderkey % 2 = 0 then 'suno' else 'udio' end as provider, case when o_orderstatus = 'P' then 'rule' else '' end as rule, {rank_sql('o_orderkey')} as r from orders),
n as (select *, case when rule = '' then row_number() over (partition by provider, owner, rule order by r) end as k from b), q as (select *, sum(case when k <= 2 then 1 else 0 end) over (partition by provider order by r rows unbounded preceding) as s from n),
c as (select *, coalesce(k <= 2 and s <= 200, false) as chosen from q), t as (select *, coalesce(sum(chosen::int) over (partition by provider, owner order by r rows between unbounded preceding and 1 preceding), 0) as taken from c)
select id, case when rule <> '' then rule when chosen then 'selected' when taken >= 2 then 'owner_cap' else 'provider_quota' end as reason from t""")
def w07(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 300).alias("owner"), F.when(F.col("o_orderkey") % 2 == 0, "suno").otherwise("udio").alias("provider"), "o_orderstatus")
    return selection.quota_selection(rows, [("rule", F.col("o_orderstatus") == "P")], "provider", "owner", "id").select("id", "reason")


@query("w09_balanced_rounds", f"""with e as (select doc_id, source, sha256(text) as g, {rank_sql('doc_id')} as r from documents where lang = 'en'), o as (select * from e qualify row_number() over (partition by g order by r) = 1),
t as (select *, row_number() over (partition by source order by r) as turn from o) select doc_id, source from t order by turn, {rank_sql("'codec-cell:' || source")} limit 50""")
def w09(spark, sf):
    rows = _docs(spark, sf).where("lang = 'en'").select("doc_id", "source", hashing.sha256_hex("text").alias("g"))
    return selection.balanced_rounds(rows, "source", "g", "doc_id", 50).select("doc_id", "source")


@query("w10_preferred_take", f"""select l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_suppkey % 20 order by case when l_returnflag = 'R' then 0 else 1 end, {rank_sql('l_orderkey')}, l_linenumber) <= 10""")
def w10(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_suppkey") % 20).alias("g"))
    return selection.preferred_take(items, "g", "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", 10).select("l_orderkey", "l_linenumber")


@query("w11_budget_fill", f"""with recursive t as (select o_orderkey::varchar as path, o_orderpriority as g, length(o_orderpriority) as size, case o_orderpriority when '5-LOW' then 1 else 0 end as tier, case o_orderpriority when '5-LOW' then 100 else 40 end as cap,
  row_number() over (partition by o_orderpriority order by {rank_sql('o_custkey')}, o_orderkey::varchar) as turn from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')),
q as (select *, row_number() over (order by tier, turn, g) as i from t where turn <= cap), r(i, room, taken) as (select 0::bigint, 700::bigint, false union all select q.i, case when q.size <= r.room then r.room - q.size else r.room end, q.size <= r.room from r join q on q.i = r.i + 1)
select path, g from r join q using (i) where taken""")
def w11(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("g"), F.length("o_orderpriority").alias("size"))
    tiers = [{"1-URGENT": 40, "2-HIGH": 40}, {"5-LOW": 100}]
    return selection.budget_fill(rows, tiers, 700, "g", "family", "path", "size").select("path", "g")


@query("w12_runs", """with e as (select user_id, event_id, value >= 50 as hit, row_number() over (partition by user_id order by event_id) - 1 as n from events), f as (select *, n - row_number() over (partition by user_id, hit order by event_id) as isl from e)
select user_id, (min(n) * 5)::int as start, ((max(n) + 1) * 5)::int as "end" from f where hit group by user_id, isl having count(*) >= 2""")
def w12(spark, sf):
    return selection.runs(table(spark, sf, "events"), ["user_id"], "event_id", F.col("value"), 50.0)


@query("w13_extremes", f"""with {C}, f as (select track_id from cohort qualify row_number() over (partition by source order by {rank_sql('track_id')}) = 1),
a as (select track_id from cohort order by n_chars, {rank_sql('track_id')} limit 1), b as (select track_id from cohort order by n_chars desc, {rank_sql('track_id')} desc limit 1) select track_id from f union select track_id from a union select track_id from b""")
def w13(spark, sf):
    return selection.extremes(cohort(spark, sf).select("track_id", "source", "n_chars"), "source", "n_chars", "track_id").select("track_id")


@query("w15_stride", "select event_id from (select event_id, row_number() over (partition by event_type order by event_id) - 1 as n from events) where n % 17 = 0")
def w15(spark, sf):
    return selection.stride(table(spark, sf, "events"), [F.col("event_id")], 17, ["event_type"]).select("event_id")


@query("w19_ranking", f"""with {C}, s as (select source, round(avg(prob), 9) as mean from cohort where prob is not null group by source) select source, mean, row_number() over (order by mean desc, source)::int as place from s""")
def w19(spark, sf):
    s = cohort(spark, sf).where("prob is not null").groupBy("source").agg(F.round(F.avg("prob"), 9).alias("mean"))
    return summaries.ranking(s, "mean", "source")


@query("w23_x03_pending", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_shipdate < timestamp '1998-01-01')")
def w23(spark, sf):
    done = table(spark, sf, "lineitem").where("l_shipdate < timestamp '1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing_rows(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


# --- audits -------------------------------------------------------------------

@query("a03_value_counts", "select coalesce(case when event_type = 'view' then null else event_type end, '<missing>') as value, count(*) as n from events group by 1")
def a03(spark, sf):
    rows = table(spark, sf, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("t"))
    return summaries.value_counts(rows, "t")


@query("a04_duplicates", "select sha256(text) as value, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as rows from documents group by 1 having count(*) > 1")
def a04(spark, sf):
    return summaries.duplicates(_docs(spark, sf).select("doc_id", hashing.sha256_hex("text").alias("h")), "h", "doc_id")


@query("a05_manifest_audit", """with c as (select count(*) as n, count(distinct doc_id) as k, count(*) filter (text is null or text = '') as t, count(*) filter (source is null or source = '') as s from documents)
select unnest(['rows', 'distinct', 'missing:text', 'missing:source']) as "check", unnest([1000::bigint, null, 0, 0]) as expected, unnest([n, k, t, s]) as actual,
  unnest([case when n = 1000 then 'match' else 'mismatch' end, 'missing_metadata', case when t = 0 then 'match' else 'mismatch' end, case when s = 0 then 'match' else 'mismatch' end]) as status from c""")
def a05(spark, sf):
    return summaries.manifest_audit(_docs(spark, sf), {"rows": 1000}, ["text", "source"], "doc_id")


FOLDERS = """f as (select 'g' || (l_suppkey % 5) || '/h' || l_linenumber as folder, l_orderkey as size, case when l_returnflag = 'R' then 'mp3' when l_returnflag = 'A' then 'wav' else '' end as ext, l_suppkey as shard from lineitem)"""


@query("a06_z08_folder_rollup", f"""with {FOLDERS}, e as (select folder, string_agg(ext || '=' || n, ',' order by ext || '=' || n) as extensions from (select folder, ext, count(*) as n from f group by folder, ext) group by folder)
select f.folder, count(*) as files, sum(size)::bigint as bytes, count(distinct shard) as shards, any_value(e.extensions) as extensions from f join e on e.folder = f.folder group by f.folder""")
def a06(spark, sf):
    items = table(spark, sf, "lineitem")
    ext = F.when(F.col("l_returnflag") == "R", "mp3").when(F.col("l_returnflag") == "A", "wav").otherwise("")
    path = F.concat(F.lit("g"), F.col("l_suppkey") % 5, F.lit("/h"), F.col("l_linenumber"), F.lit("/x"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    files = items.select(path.alias("path"), F.col("l_orderkey").alias("size"), "l_suppkey")
    return summaries.folder_rollup(files, texts.depth_key("path", 2), "size", texts.extension("path"), "l_suppkey")


@query("z08_total_row", "select coalesce(event_type, 'total') as event_type, n from (select event_type, count(*)::bigint as n from events group by rollup (event_type))")
def z08(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return summaries.with_total(counts, "event_type", ["n"])


@query("a18_release_counters", f"with {C} select split, source, label, count(*) as n, count(distinct cluster) as clusters from cohort group by split, source, label")
def a18(spark, sf):
    return summaries.release_counters(cohort(spark, sf), ["split", "source", "label"], ["cluster"])


@query("a20_u04_exposure_reasons", """select lower(o_orderpriority) as creator, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as reasons from orders group by 1""")
def a20(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.lower("o_orderpriority").alias("creator")).agg(F.collect_set("o_orderstatus").alias("a"))
    return rows.select("creator", F.array_join(joins.reason_union("a", "a"), ",").alias("reasons"))


@query("a21_f33_conflicts", """select 'k' || (l_orderkey % 500) as "group", 'l_linestatus' as field, count(distinct l_linestatus) as n from lineitem group by 1 having count(distinct l_linestatus) > 1
union all select 'k' || (l_orderkey % 500), 'l_returnflag', count(distinct l_returnflag) from lineitem group by 1 having count(distinct l_returnflag) > 1""")
def a21(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("k", F.concat(F.lit("k"), F.col("l_orderkey") % 500))
    return constraints.conflicting(rows, "k", ["l_linestatus", "l_returnflag"])


@query("a24_index_totals", "select l_suppkey as shard, count(*) as files, count(distinct l_orderkey) as paths, sum(l_linenumber)::bigint as bytes from lineitem group by 1")
def a24(spark, sf):
    return summaries.index_totals(table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber")


@query("a28_label_conflicts", "select sha256(d.text) as \"group\", 'toxic' as field, count(distinct toxic) as n from documents d join labels l using (doc_id) group by 1 having count(distinct toxic) > 1")
def a28(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(hashing.sha256_hex("text").alias("g"), "toxic")
    return constraints.conflicting(rows, "g", ["toxic"])


# --- graphs --------------------------------------------------------------------

LINKS = """l as (select o_orderkey as a, 1000000000000 + o_custkey as b from orders)"""


@query("g01_components", f"""with recursive {LINKS}, e as (select a, b from l union select b, a from l), r(node, root) as (select a, a from e union select e.b, r.root from r join e on r.node = e.a)
select node, min(root) as root from r group by node""")
def g01(spark, sf):
    orders = table(spark, sf, "orders")
    return graph.components(orders.select(F.col("o_orderkey").alias("a"), (F.lit(1000000000000) + F.col("o_custkey")).alias("b")))


@query("g01_one_large_component", """with recursive l as (select distinct l_orderkey as a, 1000000000000 + l_partkey as b from lineitem), e as (select a, b from l union all select b, a from l),
r(node) as (select min(a) from l union select e.b from r join e on r.node = e.a) select node, (select min(a) from l) as root from r""")
def g01_large(spark, sf):
    items = table(spark, sf, "lineitem")
    return graph.components(items.select(F.col("l_orderkey").alias("a"), (F.lit(1000000000000) + F.col("l_partkey")).alias("b")))


@query("g02_g03_recording_groups", f"""with d as (select doc_id::varchar as key, sha256(text) as h from documents), g as (select h, 'recording:' || substr(sha256(string_agg(key, chr(10) order by key)), 1, 24) as label from d group by h)
select d.key, g.label, {rank_sql('d.key')} = min({rank_sql('d.key')}) over (partition by g.label) as representative from d join g using (h)""")
def g02(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("key"), hashing.sha256_hex("text").alias("h"))
    labels = graph.group_labels(docs, graph.shared_value_links(docs, "key", ["h"]), "recording:")
    return graph.representatives(labels).select("key", "label", "representative")


@query("g04_dependence_clusters", """with recursive d as (select doc_id::varchar as key, sha256(text) as h, case when lang = 'fr' then source || '/' || n_chars end as owner from documents),
e as (select distinct a.key as a, b.key as b from d a join d b on a.h = b.h or a.owner = b.owner), r(node, root) as (select key, key from d union select e.b, r.root from r join e on r.node = e.a),
g as (select node as key, min(root) as root from r group by node), l as (select root, 'cluster:' || substr(sha256(string_agg(key, chr(10) order by key)), 1, 24) as label from g group by root)
select key, label from g join l using (root)""")
def g04(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("key"), hashing.sha256_hex("text").alias("h"), F.when(F.col("lang") == "fr", F.concat_ws("/", "source", F.col("n_chars"))).alias("owner"))
    return graph.group_labels(docs, graph.shared_value_links(docs, "key", ["h", "owner"]), "cluster:").select("key", "label")


@query("g05_strata", f"""with recursive {C}, p as (select distinct cluster, label || '|' || source as cell from cohort), e as (select distinct a.cell as a, b.cell as b from p a join p b on a.cluster = b.cluster),
r(node, root) as (select a, a from e union select e.b, r.root from r join e on r.node = e.a) select node as cell, min(root) as stratum from r group by node""")
def g05(spark, sf):
    return graph.strata(cohort(spark, sf).withColumn("cell", F.concat_ws("|", "label", "source")), "cluster", "cell")


@query("g06_exposed_by_owner", """with r as (select o_orderkey, o_orderkey % 97 as alias, o_custkey as owner from orders), h as (select distinct owner from r where alias in (3, 5, 8))
select o_orderkey, alias in (3, 5, 8) or owner in (select owner from h) as exposed from r""")
def g06(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("al"), F.col("o_custkey").alias("owner"))
    exposed = rows.where(F.col("al").isin(3, 5, 8)).select(F.col("al").alias("alias")).distinct()
    return graph.exposed_by_owner(rows, "al", "owner", exposed).select("o_orderkey", "exposed")


MEMBERS = """m as (select o_orderkey as id, case o_orderkey % 8 when 0 then 'Jamendo/song' || o_custkey || '.mp3' when 1 then 'OOD FMA/' || o_custkey || '.mp3' when 2 then 'suno_generated_music/s' || o_custkey || '.wav'
  when 3 then 'magnet_generated_music/Jamedo/t' || o_custkey || '.wav' when 4 then 'aac_generated_music/suno_generated_music/root/s' || o_custkey || '_aac64.wav' when 5 then 'pgd_generated_music/magnet_generated_music/adv_t' || o_custkey || '.wav'
  when 6 then 'ai_human_co-created_music/jamendo/song' || o_custkey || '_edited.mp3' else 'Caption/x' || o_custkey || '.csv' end as path from orders)"""


def _members(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("c"), (F.col("o_orderkey") % 8).alias("k"))
    k, c = F.col("k"), F.col("c")
    path = (
        F.when(k == 0, F.concat(F.lit("Jamendo/song"), c, F.lit(".mp3"))).when(k == 1, F.concat(F.lit("OOD FMA/"), c, F.lit(".mp3")))
        .when(k == 2, F.concat(F.lit("suno_generated_music/s"), c, F.lit(".wav"))).when(k == 3, F.concat(F.lit("magnet_generated_music/Jamedo/t"), c, F.lit(".wav")))
        .when(k == 4, F.concat(F.lit("aac_generated_music/suno_generated_music/root/s"), c, F.lit("_aac64.wav")))
        .when(k == 5, F.concat(F.lit("pgd_generated_music/magnet_generated_music/adv_t"), c, F.lit(".wav")))
        .when(k == 6, F.concat(F.lit("ai_human_co-created_music/jamendo/song"), c, F.lit("_edited.mp3"))).otherwise(F.concat(F.lit("Caption/x"), c, F.lit(".csv")))
    )
    return o.select("id", path.alias("path"))


@query("p07_p08_p09_p10_classified", f"""with {MEMBERS}, s as (select id, id % 8 as k, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(mp3|wav|csv)$', '') as stem from m)
select id, case k when 0 then 'human' when 1 then 'human' when 7 then 'meta' else 'ai' end as kind,
  case k when 0 then 'human_jamendo' when 1 then 'human_fma_ood' when 2 then 'suno' when 3 then 'magnet' when 4 then 'suno__aac' when 5 then 'magnet__pgd' when 6 then 'co_created' end as "group",
  case k when 0 then 'clean' when 1 then 'clean' when 2 then 'clean' when 3 then 'clean' when 4 then 'aac' when 5 then 'pgd' when 6 then 'co_created' end as variant,
  case k when 0 then 'jamendo' when 1 then 'fma' when 2 then 'none' when 3 then 'jamendo' when 4 then 'none' when 5 then '*' when 6 then 'jamendo' end as caption_set,
  case k when 4 then replace(stem, '_aac64', '') when 5 then substr(stem, 5) when 6 then replace(stem, '_edited', '') when 7 then null else stem end as base_key,
  case k when 4 then 'aac64' when 5 then 'pgd' end as transform_param from s""")
def p07(spark, sf):
    return catalogue.classified(_members(spark, sf)).select("id", "kind", "group", "variant", "caption_set", "base_key", "transform_param")


@query("j13_g07_exposure_in_families", """with m as (select o_orderkey as id, o_orderkey % 8 as k, o_custkey::varchar as c from orders where o_orderkey % 8 <> 7),
n as (select id, k, case k when 0 then 'song' || c when 1 then c when 2 then 's' || c when 3 then 't' || c when 4 then 's' || c when 5 then 't' || c else 'song' || c end as base,
  case when k in (2, 4) then 'suno' when k = 1 then 'fma' when k <> 5 then 'jamendo' when exists (select 1 from orders o where o.o_orderkey % 8 = 3 and o.o_custkey::varchar = m.c) then 'jamendo' else 'unknown' end as owner from m),
s as (select distinct owner, base from n where k in (0, 1, 2) and length(base) = 7), j as (select n.*, s.base is not null as hit from n left join s on s.owner = n.owner and s.base = n.base)
select id, hit and k in (0, 1, 2, 4, 6) as seen, case when not hit then null when k in (0, 1, 2) then 'named in a training list' when k = 4 then 'transform of named in a training list' when k = 6 then 'co-created remix of named in a training list' end as evidence from j""")
def g07(spark, sf):
    rows = catalogue.resolved_captions(stage(catalogue.classified(_members(spark, sf)).where("kind <> 'meta'"), "members"))
    seen = rows.where(F.col("generator").isin("human", "suno") & (F.col("variant") == "clean") & (F.length("base_key") == 7)).select("family", F.lit("named in a training list").alias("evidence")).distinct()
    return catalogue.inherited_exposure(rows, seen).select("id", "seen", "evidence")


# --- similarity -------------------------------------------------------------

@query("j17_exact_copies", """select 'h' as kind, sha256(text) as digest, count(*) as n, min(doc_id) as first from documents group by 2 having count(*) > 1
union all select 'k', lang || n_chars, count(*), min(doc_id) from documents group by 2 having count(*) > 1""")
def j17(spark, sf):
    rows = _docs(spark, sf).select("doc_id", hashing.sha256_hex("text").alias("h"), F.concat("lang", F.col("n_chars").cast("string")).alias("k"))
    return similarity.exact_copies(rows, "doc_id", ["h", "k"])


@query("j16_s41_sign_bit_links", """with e as (select vec_id, embedding as x from embeddings union all select vec_id + 1000000, list_transform(embedding, lambda x, i: case when i <= vec_id % 5 then -x else x end) from embeddings),
v as (select vec_id, list_transform(x, lambda x: (x > 0)::int) as v from e), b as (select min(vec_id) as vec_id, v from v group by v)
select b.vec_id as a, v.vec_id as b, 0 as distance from b join v on b.v = v.v and b.vec_id <> v.vec_id union all select a.vec_id as a, b.vec_id as b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] <> p[2])::int))::int as distance from b a join b on a.vec_id < b.vec_id
where list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] <> p[2])::int)) <= 3""")
def j16(spark, sf):
    """Embeddings and copies of them in which up to four signs are turned."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 5, -x).otherwise(x))
    both = rows.unionByName(rows.select((F.col("vec_id") + 1000000).alias("vec_id"), turned.alias("embedding")))
    return similarity.block_links(both.select("vec_id", similarity.sign_bits(F.col("embedding")).alias("bits")), "vec_id", "bits", 3)


def _sequences(spark, sf):
    """Sequences of 32-bit frames for pairs of documents, the second shifted by ten frames."""
    ids = _docs(spark, sf).select("doc_id")
    frames = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.xxhash64(F.floor(F.col("doc_id") / 2), i + (F.col("doc_id") % 2) * 10).bitwiseAND(0xFFFFFFFF))
    return ids.select("doc_id", frames.alias("fp"))


@query("j16_copy_candidates", """select a.doc_id as a, b.doc_id as b, 0.0::double as bit_error, 110 as frames, 10::bigint as "offset" from documents a join documents b on b.doc_id = a.doc_id + 1 where a.doc_id % 2 = 0""")
def j16_copies(spark, sf):
    return rounded(similarity.copy_candidates(_sequences(spark, sf), "doc_id", "fp"))


@query("r01_correlation", """with v as (select vec_id, embedding::double[] as e from embeddings), p as (select a.vec_id as a, a.e as x, b.e as y from v a join v b on b.vec_id = a.vec_id + 1),
m as (select a, list_transform(x, lambda t: t - list_avg(x)) as x, list_transform(y, lambda t: t - list_avg(y)) as y from p)
select a, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 6) as correlation from m""")
def r01(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = v.join(v.select((F.col("vec_id") - 1).alias("a"), F.col("e").alias("next")), F.col("vec_id") == F.col("a"))
    return p.select("a", F.round(similarity.normalized_correlation(F.col("e"), F.col("next")), 6).alias("correlation"))


# --- published rows ------------------------------------------------------------

@query("p01_s02_public_rows", """with d as (select doc_id, source, sha256(text) as h from documents)
select 'ab2-' || substr(h, 1, 20) as public_id, source, 'ab2l-' || substr(sha256(h), 1, 20) as public_lineage, sha256('split:' || source || ':' || h) as split_rank, sha256(doc_id::varchar) as legacy_id_sha256,
  case when starts_with(source, 'src1') then 'archive' else 'reference' end as mode from d""")
def p01(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").alias("track_id"), F.lit("ai").alias("label"), "source", hashing.sha256_hex("text").alias("audio_sha256"), F.lit(None).cast("string").alias("lineage_id"))
    out = projections.public_rows(rows, "split", {"src1": ("archive", "a"), "src": ("reference", "b")})
    return out.select("public_id", "source", "public_lineage", "split_rank", "legacy_id_sha256", F.col("retrieval.mode").alias("mode"))


@query("p03_prediction_rows", f"with {C} select track_id as id, case when prob is not null then 'scored' else 'error' end as outcome, prob, case when prob is null then stage end as error from cohort")
def p03(spark, sf):
    rows = cohort(spark, sf).select(F.col("track_id").alias("id"), F.when(F.col("prob").isNotNull(), "scored").otherwise("error").alias("outcome"), "prob", F.col("stage").alias("error"))
    return projections.prediction_rows(rows)


@query("p13_prefix_groups", f"with {C} select case when starts_with(source, 'src1') then 'one' when starts_with(source, 'src') then 'other' end as grp, count(*) as n from cohort group by 1")
def p13(spark, sf):
    return cohort(spark, sf).groupBy(projections.prefix_case(F.col("source"), {"src1": "one", "src": "other"}).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("p16_unnested_variants", "with c as (select conv_id, list(role order by turn) as roles from conversations group by conv_id) select conv_id, (i - 1)::int as at, roles[i] as variant from c, unnest(generate_series(1, len(roles))) u(i)")
def p16(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return projections.unnested_variants(rows, "roles", ["conv_id"])


@query("p28_p26_wide_by_language", f"""with {C}, s as (select source, lang, round(avg(prob), 9) as m from cohort where prob is not null group by source, lang)
select source, max(m) filter (lang = 'de') as de, max(m) filter (lang = 'en') as en, max(m) filter (lang = 'es') as es, max(m) filter (lang = 'fr') as fr from s group by source""")
def p28(spark, sf):
    s = cohort(spark, sf).where("prob is not null").groupBy("source", "lang").agg(F.round(F.avg("prob"), 9).alias("m"))
    return projections.wide(s, "source", "lang", "m", ["de", "en", "es", "fr"])
