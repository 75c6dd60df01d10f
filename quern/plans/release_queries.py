"""Gates of runs and releases over the evaluation tables.

Each gate gets tables in which some rows are wrong by a rule of their ids, so that what it
finds, and what it leaves alone, is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, nested, texts
from ..operators import constraints, releases
from .base import cohort, cohort_sql, rounded, table
from .catalog import query

C = cohort_sql()


def _seed_sql(key: str) -> str:
    return f"('0x' || substr(sha256('260905:' || {key}::varchar), 1, 8))::ubigint::bigint"


RUN = f"""{C}, run as (select track_id as id, case when track_id % 37 = 0 then 1 - label else label end as label, source,
  case when prob is not null then 'scored' when stage = 'inference' then 'model_execution_error' else 'input_execution_error' end as outcome,
  sha256(track_id || chr(9) || label) as want, case when track_id % 41 = 0 then sha256('x') else sha256(track_id || chr(9) || label) end as digest from cohort where track_id % 43 <> 0)"""


def _run(spark, sf):
    rows, i = cohort(spark, sf), F.col("track_id")
    outcome = F.when(F.col("prob").isNotNull(), "scored").when(F.col("stage") == "inference", "model_execution_error").otherwise("input_execution_error")
    own = hashing.record_digest("track_id", "label")
    return rows.where(i % 43 != 0).select(
        i.alias("id"), F.when(i % 37 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), "source", outcome.alias("outcome"),
        own.alias("want"), F.when(i % 41 == 0, hashing.sha256_hex(F.lit("x"))).otherwise(own).alias("digest"), "prob",
    )


def _manifest(spark, sf):
    return cohort(spark, sf).select(F.col("track_id").alias("id"), "label", "source")


@query("c05_completed_run", f"""with {RUN} select id::varchar as key, 'label differs' as rule from run where id % 37 = 0 union all select id::varchar, 'digest differs' from run where id % 41 = 0
union all select track_id::varchar, 'absent' from cohort where track_id % 43 = 0
union all select outcome, 'count differs' from run where outcome = 'scored' group by outcome""")
def c05(spark, sf):
    run = _run(spark, sf)
    claimed = run.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") + F.when(F.col("outcome") == "scored", 1).otherwise(0))
    return releases.completed_run(run, _manifest(spark, sf), run.select("id", F.col("want").alias("digest")), claimed)


PUBLIC = f"""{C}, pub as (select track_id as id, label, source, case when prob is not null then 'scored' when stage = 'inference' then 'model_execution_error' else 'input_execution_error' end as outcome,
  case when prob is not null then case when track_id % 29 = 0 then prob + 1 else prob end end as prob, case when prob is not null then (track_id % 50) / 50.0::double end as rescue_prob, track_id from cohort)"""


def _public(spark, sf):
    i, p = F.col("track_id"), F.col("prob")
    rows = cohort(spark, sf)
    outcome = F.when(p.isNotNull(), "scored").when(F.col("stage") == "inference", "model_execution_error").otherwise("input_execution_error")
    score, rescue = F.when(i % 29 == 0, p + 1).otherwise(p), F.when(p.isNotNull(), (i % 50) / 50.0)
    seed = hashing.record_seed(F.concat(F.lit("260905:"), i.cast("string")))
    return rows.select(
        i.alias("id"), "label", "source", outcome.alias("outcome"), score.alias("prob"), rescue.alias("rescue_prob"),
        F.when(p.isNotNull(), (score >= 0.225) & (rescue >= F.when(i % 31 == 0, 0.5).otherwise(0.02))).alias("production_ai"),
        F.when(p.isNull(), F.when(i % 3 == 0, "not a name!").otherwise("ValueError")).alias("error_type"), F.when(i % 47 == 0, 1).otherwise(seed).alias("seed"),
    )


@query("c06_f03_public_results", f"""with {PUBLIC} select id::varchar as key, 'a score is a probability' as rule from pub where prob > 1
union all select id::varchar, 'a decision follows the cuts' from pub where prob is not null and id % 31 = 0 and (prob >= 0.225) and rescue_prob >= 0.02 and rescue_prob < 0.5
union all select id::varchar, 'an error class is a name' from pub where prob is null and id % 3 = 0
union all select id::varchar, 'the seed follows from the id' from pub where id % 47 = 0 and {_seed_sql('id')} <> 1""")
def c06(spark, sf):
    rows = _public(spark, sf)
    outcomes = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return releases.public_results(rows, _manifest(spark, sf), outcomes, set(rows.columns))


@query("f04_f05_strict_probabilities", f"with {PUBLIC} select id::varchar as key from pub where prob > 1")
def f04(spark, sf):
    rule = "a score is a probability"
    return constraints.violations(_public(spark, sf), "id", {rule: releases.record_rules()[rule]}).select("key")


@query("k11_o17_exported_predictions", f"""with {C} select 'model_' || (track_id % 3) as file, count(*) as n, sum(('0x' || substr(sha256(track_id || chr(9) || coalesce(floor(prob * 1000 + 0.5)::bigint::varchar, '')), 1, 12))::ubigint)::bigint as digest from cohort group by 1""")
def k11(spark, sf):
    import uuid

    from ..storage import shared_dir

    rows = cohort(spark, sf).select(F.concat(F.lit("model_"), F.col("track_id") % 3).alias("model"), F.col("track_id").alias("id"), F.floor(F.col("prob") * 1000 + 0.5).alias("milli"))
    path = f"{shared_dir(spark)}/quern-predictions-{uuid.uuid4().hex}"
    rows.write.partitionBy("model").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    return releases.file_digests(back, "model", ["id", "milli"])


@query("o17_o18_f30_f32_bindings", f"""with {C} select source as key, 'changed' as rule from cohort where source in ('src3', 'src8') and prob is not null group by source
union all select distinct source, 'missing' from cohort where source = 'src5' and prob is not null""")
def o17(spark, sf):
    scored = cohort(spark, sf).where("prob is not null")
    published = releases.file_digests(scored.withColumn("prob", F.when(F.col("source").isin("src3", "src8"), 1 - F.col("prob") / 2).otherwise(F.col("prob"))), "source", ["track_id", "prob"])
    return releases.binding(releases.file_digests(scored.where("source <> 'src5'"), "source", ["track_id", "prob"]), published)


@query("c43_f31_summary_gate", f"with {C} select 'run' as key, 'attempted is ' || 5 as rule from cohort having count(*) <> 5 union all select 'run', 'status is complete' from cohort where label > 1 having count(*) > 0")
def c43(spark, sf):
    summary = cohort(spark, sf).agg(F.lit("run").alias("name"), F.lit("complete").alias("status"), F.lit(2000).alias("replicates"), F.count(F.lit(1)).alias("attempted"))
    return releases.one_row(summary, "name", {"status": "complete", "replicates": 2000, "attempted": 5})


@query("f20_input_condition", f"with {C} select track_id::varchar as key, 'condition is soxr/2' as rule from cohort where stage is distinct from 'missing' and lang = 'fr'")
def f20(spark, sf):
    rows = cohort(spark, sf).withColumn("outcome", F.when(F.col("stage") == "missing", "input_execution_error").otherwise("scored"))
    return releases.input_condition(rows.withColumn("condition", F.when(F.col("lang") != "fr", "soxr/2")), "soxr/2", "track_id")


@query("f21_f22_f23_equal_conditions", "select s_suppkey::varchar as key, 's_nationkey differs' as rule from supplier where s_suppkey % 9 = 0 union all select s_suppkey::varchar, 's_name differs' from supplier where s_suppkey % 14 = 0")
def f21(spark, sf):
    now = table(spark, sf, "supplier")
    then = now.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 9 == 0, -1).otherwise(F.col("s_nationkey"))).withColumn("s_name", F.when(F.col("s_suppkey") % 14 != 0, F.col("s_name")))
    return releases.equal_conditions(now, then, "s_suppkey", ["s_nationkey", "s_name", "s_acctbal"])


@query("p04_preprocessing_rules", """select event_id::varchar as key, 'levels are finite' as rule from events where event_id % 10 = 0 union all select event_id::varchar, 'sizes are positive' from events where event_id % 7 = 0
union all select event_id::varchar, 'the decoder''s route is declared' from events where event_type = 'error'""")
def p04(spark, sf):
    i = F.col("event_id")
    made = F.struct(
        F.lit("soxr/2").alias("condition"), F.when(F.col("event_type") == "error", "other").when(i % 2 == 0, "soundfile").otherwise("ffmpeg").alias("decoder"),
        F.when(i % 2 != 0, "LibsndfileError").alias("error_type"), F.lit(44100).alias("rate"), F.when(i % 7 == 0, 0).otherwise(2).alias("channels"), (i + 1).alias("frames"),
        F.lit(16000).alias("model_rate"), F.lit(64000).alias("model_frames"), hashing.sha256_hex("event_id").alias("sha256"),
        F.when(i % 10 == 0, -1.0).otherwise(F.col("value")).alias("peak"), F.col("value").alias("rms"),
    )
    rows = table(spark, sf, "events").select("event_id", made.alias("input"))
    return constraints.violations(rows, "event_id", releases.preprocessing_rules(("soxr/2",), {"soundfile": None, "ffmpeg": "LibsndfileError"}, 16000, 64000))


@query("f29_u08_u09_bundle", """with f as (select p_partkey as k, 'd' || (p_partkey % 7) || '/' || p_partkey as file from part)
select case when k % 13 = 0 then '../' || file else file end as key, 'name stays inside' as rule from f where k % 13 = 0
union all select case when k % 13 = 0 then '../' || file else file end, 'changed' from f where k % 17 = 0 and k % 11 <> 0 and k % 13 <> 0
union all select case when k % 13 = 0 then '../' || file else file end, 'missing' from f where k % 11 = 0 or k % 13 = 0
union all select file, 'unlisted' from f where k % 13 = 0 and k % 11 <> 0 union all select 'release.json', 'required'""")
def f29(spark, sf):
    k = F.col("p_partkey")
    file = F.concat(F.lit("d"), k % 7, F.lit("/"), k)
    files = table(spark, sf, "part").select(k, file.alias("file"), hashing.sha256_hex("p_name").alias("digest"))
    listed = files.withColumn("file", F.when(k % 13 == 0, F.concat(F.lit("../"), "file")).otherwise(F.col("file"))).withColumn("digest", F.when(k % 17 == 0, hashing.sha256_hex(F.lit("x"))).otherwise(F.col("digest")))
    return releases.bundle(listed.select("file", "digest"), files.where(k % 11 != 0).select("file", "digest"), ["release.json"])


@query("p05_p06_relative_names", "select p_partkey, p_brand || '/' || p_partkey as file from part")
def p05(spark, sf):
    files = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/data/root/"), "p_brand", F.lit("/"), "p_partkey").alias("path"))
    return releases.relative_names(files, "/data/root").select("p_partkey", "file")


@query("j20_j30_j31_rebound", "select o_orderkey::varchar as key, case when o_orderkey % 5 = 0 then 'no evidence' else 'evidence of other content' end as rule from orders where o_orderkey % 5 = 0 or o_orderstatus = 'P'")
def j30(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cached = orders.where("o_orderkey % 5 <> 0").withColumn("o_custkey", F.when(F.col("o_orderstatus") == "P", -1).otherwise(F.col("o_custkey"))).drop("o_orderstatus")
    return releases.rebound(cached, orders, ["o_orderkey"], ["o_custkey"])[1]


@query("p30_bound_cases", "select count(*) as n from orders where o_orderkey % 5 <> 0 and o_orderstatus <> 'P'")
def p30(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cached = orders.where("o_orderkey % 5 <> 0").withColumn("o_custkey", F.when(F.col("o_orderstatus") == "P", -1).otherwise(F.col("o_custkey"))).drop("o_orderstatus")
    return releases.rebound(cached, orders, ["o_orderkey"], ["o_custkey"])[0].agg(F.count(F.lit(1)).alias("n"))


@query("o09_review_verdicts", """select l_orderkey, l_linenumber, case when l_returnflag = 'R' and (least(l_partkey, l_suppkey + 1) >= 0.98 * greatest(l_partkey, l_suppkey + 1) or l_linestatus = 'F') then 'same_recording_or_excerpt'
  when l_returnflag in ('R', 'A') then 'shared_audio_lineage_not_identical_recording' else 'not_confirmed_as_shared_audio' end as verdict from lineitem""")
def o09(spark, sf):
    items = table(spark, sf, "lineitem")
    pairs = items.select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("confirmed"), (F.col("l_returnflag") == "A").alias("shared"),
        F.col("l_partkey").alias("length_a"), (F.col("l_suppkey") + 1).alias("length_b"), (F.col("l_linestatus") == "F").alias("same_original"),
    )
    return releases.review_verdicts(pairs).select("l_orderkey", "l_linenumber", "verdict")


@query("o10_corrected_identity", """select c_custkey, case when c_custkey % 3 = 0 then 'https://x/' || c_custkey when c_custkey % 2 = 0 then lower(c_name) else c_name end as url,
  case when c_custkey % 6 <> 1 then 'exact_page_link' end as source_identity_evidence, c_custkey % 6 <> 1 and (c_custkey % 3 = 0 or (c_custkey % 2 = 0 and lower(c_name) <> c_name)) as changed  from customer""")
def o10(spark, sf):
    k = F.col("c_custkey")
    entries = table(spark, sf, "customer").select(k, F.col("c_name").alias("url"))
    links = table(spark, sf, "customer").where(k % 6 != 1).select(k, F.when(k % 3 == 0, F.concat(F.lit("https://x/"), k)).when(k % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("url"))
    return releases.corrected_identity(entries, links, "c_custkey", ["url"])


FREEZE = f"""{C}, dup as (select cluster from cohort group by cluster having count(distinct toxic) > 1)"""


@query("o11_freeze_gates", f"""with {FREEZE} select track_id::varchar as key, 'not validated' as rule from cohort where stage = 'missing' union all select track_id::varchar, 'no evidence of identity' from cohort where lang = 'de' and n_chars < 1000
union all select cluster, 'two labels in a group' from dup union all select track_id::varchar, 'known exposure' from cohort where source = 'src7'
union all select a.track_id || '/' || b.track_id, 'not reviewed' from cohort a join cohort b on a.cluster = b.cluster and a.track_id < b.track_id where a.track_id % 2 = 0""")
def o11(spark, sf):
    rows = cohort(spark, sf)
    entries = rows.select("track_id", (F.col("lang") == "de").alias("native"), F.when(F.col("n_chars") >= 1000, "page").alias("source_identity_evidence"))
    conflicts = constraints.conflicting(rows, "cluster", ["toxic"])
    a, b = rows.select("cluster", F.col("track_id").alias("a")), rows.select("cluster", F.col("track_id").alias("b"))
    pairs = a.join(b, "cluster").where("a < b").select("a", "b")  # groups of copies in a small cohort of labelled rows
    return releases.freeze_gates(entries, rows.where("stage is null or stage <> 'missing'").select("track_id"), conflicts, rows.where("source = 'src7'").select("track_id"), pairs, pairs.where("a % 2 <> 0"), "track_id")


@query("o06_native_inventory", """with r as (select o_orderkey as track_id, o_custkey as variant_id, case when o_orderkey % 2 = 0 then upper(o_orderpriority) else o_orderpriority end as creator from orders)
select track_id, variant_id, creator, concat_ws(',', case when lower(creator) = '1-urgent' then 'creator: urgent' end, case when track_id % 9 = 0 then 'track: nine' end) as reasons, lower(creator) <> '1-urgent' and track_id % 9 <> 0 as eligible from r""")
def o06(spark, sf):
    orders = table(spark, sf, "orders")
    creator = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    rows = orders.select(F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("variant_id"), creator.alias("creator"))
    tracks = orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("track_id"), F.lit("track: nine").alias("reason"))
    creators = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("creator"), F.lit("creator: urgent").alias("reason")).distinct()
    return releases.native_inventory(rows, tracks, creators)


@query("o22_verify_leak", f"""with {C} select track_id::varchar as key, 'seen_in_training is present' as rule from cohort where track_id % 53 = 0 union all select track_id::varchar, 'seen_in_training agrees with seen_evidence' from cohort where track_id % 19 = 0 and track_id % 53 <> 0
union all select source || '/true', 'count differs' from cohort where source = 'src2' and toxic = 1 and track_id % 53 <> 0 group by source""")
def o22(spark, sf):
    rows, i = cohort(spark, sf), F.col("track_id")
    seen, evidence = F.col("toxic") == 1, F.when(F.expr("(toxic = 1) <> (track_id % 19 = 0)"), "id")
    named = rows.select(i, "source", F.when(i % 53 != 0, seen).alias("seen_in_training"), evidence.alias("seen_evidence"))
    counts = named.groupBy("source", F.col("seen_in_training").alias("seen")).agg(F.count(F.lit(1)).alias("n"))
    wrong = counts.withColumn("n", F.col("n") + F.when((F.col("source") == "src2") & F.col("seen"), 1).otherwise(0))
    return releases.verify_leak(named, wrong)


@query("o24_verify_production", f"""with {C} select source || '/' || track_id as key, 'no line' as rule from cohort where track_id % 23 = 0 union all select source || '/' || track_id, 'line repeated' from cohort where track_id % 21 = 0 and track_id % 23 <> 0
union all select track_id::varchar, 'neither scored nor failed' from cohort where stage = 'missing' union all select track_id::varchar, 'no decision' from cohort where prob is not null and lang = 'es'""")
def o24(spark, sf):
    rows, i = cohort(spark, sf).withColumn("path", F.concat_ws("/", "source", "track_id")), F.col("track_id")
    lines = rows.where(i % 23 != 0).select("path", F.explode(F.when(i % 21 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("line"))
    scores = rows.where("prob is not null").select("track_id", "prob", F.when(F.col("lang") != "es", F.col("prob") >= 0.5).alias("decision_ai"))
    return releases.verify_production(rows, lines, scores, rows.where("stage = 'inference'").select("track_id"))


# --- nested records and page objects ----------------------------------------------------

@query("p17_clip_records", """select page_id, case when page_id % 5 = 0 then 'no clip object of this id' when page_id % 5 = 1 then 'conflicting clip objects' when page_id % 5 = 2 then 'conflicting version evidence' end as error,
  case when page_id % 5 > 2 then 'v' || (page_id % 4) end as version, case when page_id % 5 > 2 then url end as handle from pages""")
def p17(spark, sf):
    i, url = F.col("page_id"), F.col("url")
    clip = F.struct(
        F.concat(F.lit("id"), i).alias("id"), F.concat(F.lit("v"), i % 4).alias("major_model_version"), url.alias("handle"),
        F.struct(F.struct(F.struct(F.when(i % 5 == 2, "other").otherwise(F.concat(F.lit("v"), i % 4)).alias("display_name")).alias("songcard")).alias("model_badges")).alias("metadata"),
    )
    items = F.when(i % 5 == 0, F.lit("[]")).when(i % 5 == 1, F.to_json(F.array(clip, clip.withField("handle", F.lit("else"))))).otherwise(F.to_json(F.array(clip, clip)))
    made = table(spark, sf, "pages").select("page_id", nested.record_of("clip")(items, F.concat(F.lit("id"), i)).alias("r"))
    return made.select("page_id", "r.error", F.col("r.generator_version").alias("version"), F.col("r.creator_handle").alias("handle"))


@query("p18_song_records", """select page_id, case when page_id % 4 = 0 then 'no song object of this id' when page_id % 4 = 1 then 'conflicting song objects' end as error, case when page_id % 4 > 1 then url end as artist from pages""")
def p18(spark, sf):
    i, url = F.col("page_id"), F.col("url")
    song = F.struct(F.concat(F.lit("https://h/songs/"), F.when(i % 4 == 0, "x").otherwise(F.concat(F.lit("m"), i)), F.lit("?q=1")).alias("song_path"), url.alias("artist"), F.lit("g").alias("generation_id"))
    items = F.when(i % 4 == 1, F.to_json(F.array(song, song.withField("artist", F.lit("else"))))).otherwise(F.to_json(F.array(song, song)))
    made = table(spark, sf, "pages").select("page_id", nested.record_of("song")(items, F.concat(F.lit("m"), i)).alias("r"))
    return made.select("page_id", "r.error", "r.artist")


@query("v19_replaced_strings", """select event_id, '{"a": ["new/' || event_type || '"], "n": 1}' as body from events""")
def v19(spark, sf):
    body = F.concat(F.lit('{"n": 1, "a": ["old/'), "event_type", F.lit('"]}'))
    return table(spark, sf, "events").select("event_id", nested.replaced_strings("old/", "new/")(body).alias("body"))


@query("s32_demo_urls", r"""select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(case when contains(html, '<article>') then substr(html, strpos(html, '<article>')) else '' end, 'href="([^"#?]+)"', 1))), ' ') as urls from pages""")
def s32(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(texts.demo_urls("html", "<article>"), " ").alias("urls"))


@query("s44_s45_s46_s53_names", """select p_partkey, case when p_size % 2 = 0 then 'reports/leak_report.json' else 'reports/leak_report_' || p_partkey || '.json' end as report,
  case when p_size % 3 <> 0 then '/data/' || p_partkey || '/x' end as destination, 'https://hub/' || p_partkey || '/resolve/main/a%20b/' || p_partkey || '.tar' as url, p_partkey::varchar as stem from part""")
def s44(spark, sf):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(k, F.lit("/../x"))).otherwise(F.concat(k, F.lit("/x")))
    shard = F.concat(F.lit("a b/"), k, F.lit(".tar"))
    return table(spark, sf, "part").select(
        "p_partkey", texts.report_path(F.when(F.col("p_size") % 2 != 0, k)).alias("report"), texts.destination("/data", name).alias("destination"),
        texts.shard_url("https://hub", k, F.lit("main"), shard).alias("url"), texts.shard_stem(shard).alias("stem"),
    )


@query("f14_safe_members", "select l_orderkey, l_linenumber, l_linenumber <> 2 and l_linenumber <> 4 as safe from lineitem")
def f14(spark, sf):
    n = F.col("l_linenumber")
    name = F.when(n == 2, F.concat(F.lit("../"), "l_orderkey")).when(n == 4, F.concat(F.lit("a//"), "l_orderkey")).otherwise(F.concat(F.lit("a/"), "l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", texts.safe_relative_path(name).alias("safe"))


@query("f28_asset_status", """select p_partkey::varchar as key, case when p_size % 5 = 0 then 'missing' when p_size % 5 = 1 then 'changed' end as rule from part where p_size % 5 < 2 union all select 'x' || p_partkey, 'unlisted' from part where p_size = 7""")
def f28(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_size", hashing.sha256_hex("p_name").alias("d"))
    actual = part.where("p_size % 5 <> 0").withColumn("d", F.when(F.col("p_size") % 5 == 1, "x").otherwise(F.col("d")))
    more = part.where("p_size = 7").withColumn("key", F.concat(F.lit("x"), "key"))
    return constraints.unequal_digests(part, actual.unionByName(more), "key", "d")


@query("s50_s09_ordered_digests", f"with {C} select source, sha256(string_agg(track_id::varchar, chr(10) order by n_chars, track_id)) as digest from cohort group by source")
def s09(spark, sf):
    order = F.struct("n_chars", "track_id")
    return cohort(spark, sf).groupBy("source").agg(hashing.ordered_digest(order, F.col("track_id")).alias("digest"))


@query("s04_s52_s13_s14_paths", """select l_orderkey, l_linenumber, 'mb_' || substr(sha1('g' || l_linenumber || '/h/' || l_orderkey || '.MP3'), 1, 16) as track_id, 'g' || l_linenumber as top, 'g' || l_linenumber || '/h' as depth2, 'mp3' as ext from lineitem""")
def s04(spark, sf):
    path = F.concat(F.lit("g"), "l_linenumber", F.lit("/h/"), "l_orderkey", F.lit(".MP3"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", hashing.short_id(path, "mb_", 16, "sha1").alias("track_id"), texts.top_folder(path).alias("top"),
        texts.depth_key(path, 2).alias("depth2"), texts.extension(path).alias("ext"),
    )


@query("v15_entry_seeds", f"select doc_id, {_seed_sql('doc_id')} as seed from documents")
def v15(spark, sf):
    from ..operators.scoring import entry_seed

    return table(spark, sf, "documents").select("doc_id", entry_seed(F.col("doc_id")).alias("seed"))


@query("a29_construction_counts", f"with {C} select split, label, count(*) as n, count(distinct cluster) as clusters, count(distinct source) as sources from cohort group by split, label")
def a29(spark, sf):
    from ..operators.summaries import release_counters

    return release_counters(cohort(spark, sf), ["split", "label"], ["cluster", "source"])


@query("m34_m14_comparison", f"with {C}, {cohort_sql('z', '260906')}, o as (select track_id, prob as q from z) select track_id, round(q - prob, 9) as shift, round(abs(q - prob), 9) as abs_shift, ((prob >= 0.5) <> (q >= 0.5))::int::double as flip from cohort left join o using (track_id) where prob is not null and q is not null")
def m34(spark, sf):
    from ..operators.joins import common_pairs
    from ..operators.pairs import pair_columns

    both = common_pairs(cohort(spark, sf), cohort(spark, sf, "260906"), "track_id")
    return rounded(both.select("track_id", *pair_columns("prob", "other")))
