"""Scalar functions, pages, chunks, scoring and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, intervals, nested, pages, texts, urls
from ..operators import chunks, scoring, selection
from ..storage import shared_dir
from ..streaming import ledger
from .base import cohort, rounded, table
from .catalog import query


@query("s01_s10_hashes", """select doc_id, sha256(text) as sha256, 'mb_' || substr(sha1(doc_id::varchar), 1, 16) as short, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::ubigint::bigint as seed, sha256('260905:' || doc_id) as rank from documents""")
def s01(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", hashing.sha256_hex("text").alias("sha256"), hashing.short_id("doc_id", "mb_", 16, "sha1").alias("short"), hashing.record_seed("doc_id").alias("seed"), hashing.rank_key("doc_id").alias("rank"))


@query("s05_fold_text", r"select p_partkey, trim(regexp_replace(lower(replace(p_name || '  &amp; X', '&amp;', '&')), '\s+', ' ', 'g')) as folded from part")
def s05(spark, sf):
    return table(spark, sf, "part").select("p_partkey", texts.fold_text(F.concat("p_name", F.lit("  &amp; X"))).alias("folded"))


@query("s11_s16_names", r"""with p as (select c_custkey, 'a/b' || c_nationkey || '/' || c_custkey || '_x.' || case when c_custkey % 3 = 0 then 'MP3.wav' when c_custkey % 3 = 1 then 'flac' else 'txt' end as path from customer)
select c_custkey, regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)(\.mp3\.wav|\.wav|\.mp3|\.m4a|\.ogg|\.flac)$', '') as stem, lower(regexp_extract(path, '[^.]*$')) as ext, 'a/b' || regexp_extract(path, 'b(\d+)/', 1) as folder,
  c_custkey as number, c_custkey % 3 <> 2 as audio from p""")
def s11(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "MP3.wav").when(F.col("c_custkey") % 3 == 1, "flac").otherwise("txt")
    path = F.concat(F.lit("a/b"), F.col("c_nationkey"), F.lit("/"), F.col("c_custkey"), F.lit("_x."), kind)
    rows = c.select("c_custkey", path.alias("path"))
    return rows.select("c_custkey", texts.strip_audio_extension(texts.base_name("path")).alias("stem"), texts.extension("path").alias("ext"), texts.depth_key("path", 2).alias("folder"), texts.leading_number("path").alias("number"), texts.is_audio("path").alias("audio"))


@query("s12_transform_parameters", r"""with p as (select s_suppkey, 't' || s_suppkey || case s_suppkey % 4 when 0 then '_aac64' when 1 then '_eq-cut_low' when 2 then '_pt-ps+2st-ts1.1' else '_gn0.01' end as stem, case s_suppkey % 4 when 0 then 'aac' when 1 then 'eq' when 2 then 'pitch_time' else 'gaussian' end as variant from supplier)
select s_suppkey, regexp_extract(stem, '_(.*)$', 1) as param from p""")
def s12(spark, sf):
    k = F.col("s_suppkey") % 4
    suffix = F.when(k == 0, "_aac64").when(k == 1, "_eq-cut_low").when(k == 2, "_pt-ps+2st-ts1.1").otherwise("_gn0.01")
    variant = F.when(k == 0, "aac").when(k == 1, "eq").when(k == 2, "pitch_time").otherwise("gaussian")
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("t"), F.col("s_suppkey"), suffix).alias("stem"), variant.alias("variant"))
    return rows.select("s_suppkey", texts.transform_parameter("stem", "variant").alias("param"))


@query("f13_safe_paths", r"""with p as (select n_nationkey, case n_nationkey % 5 when 0 then 'a/../b' when 1 then '/abs' when 2 then 'ok/' || n_name when 3 then 'x//y' else 'a\b' end as path from nation) select n_nationkey, n_nationkey % 5 = 2 as safe from p""")
def f13(spark, sf):
    k = F.col("n_nationkey") % 5
    path = F.when(k == 0, "a/../b").when(k == 1, "/abs").when(k == 2, F.concat(F.lit("ok/"), F.col("n_name"))).when(k == 3, "x//y").otherwise("a\\b")
    return table(spark, sf, "nation").select("n_nationkey", texts.safe_relative_path(path).alias("safe"))


@query("s17_s18_url_keys", r"""select page_id, lower(regexp_extract(url, '^[^:]*')) || '://' || lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) || regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1) as key,
  list_contains(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), 'page') as has_page from pages""")
def s17(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_key("url").alias("key"), urls.has_path_segment("url", F.lit("page")).alias("has_page"))


@query("s20_lineage_tokens", """with h as (select doc_id, substr(sha256(doc_id::varchar), 1, 32) as x from documents)
select doc_id, case when doc_id % 4 = 0 then 'suno:' || x when doc_id % 4 = 1 then 'suno:' || x else '' end as ids from h""")
def s20(spark, sf):
    docs, k = table(spark, sf, "documents"), F.col("doc_id") % 4
    x = F.substring(hashing.sha256_hex("doc_id"), 1, 32)
    v = F.when(k == 0, F.upper(x)).when(k == 1, F.concat(F.lit("https://site.example/song/"), x)).when(k == 2, "0" * 32).otherwise("not an id")
    return docs.select("doc_id", F.array_join(urls.lineage_tokens(v, F.lit("suno")), ",").alias("ids"))


@query("s22_identity_kinds", """select doc_id, case doc_id % 4 when 0 then 'sonics:fake_' || doc_id || '_suno_0' when 1 then 'fma:' || doc_id when 2 then 'mtg:' || doc_id end as kind from documents""")
def s22(spark, sf):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    v = F.when(k == 0, F.concat(F.lit("/x/fake_"), i, F.lit("_suno_0.mp3"))).when(k == 1, F.concat(F.lit("cell:fma_full:000"), i)).when(k == 2, F.concat(F.lit("/d/mtg-jamendo/"), i, F.lit(".low.mp3"))).otherwise(F.concat(F.lit("/other/"), i, F.lit(".mp3")))
    return table(spark, sf, "documents").select("doc_id", urls.identity_kind(v).alias("kind"))


@query("s25_s28_record_ends", "select l_orderkey, l_linenumber, ((l_orderkey + 511) // 512) * 512 as padded, l_partkey + ((l_orderkey + 511) // 512) * 512 as ending from lineitem")
def s25(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", texts.padded("l_orderkey").alias("padded"), texts.record_end("l_partkey", "l_orderkey").alias("ending"))


@query("s33_levels", "select event_id, round(20 * log10(greatest(value / 1000, 1e-12)), 9) as dbfs from events")
def s33(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", chunks.dbfs(F.col("value") / 1000).alias("dbfs")))


@query("s34_s36_texts", """select event_type, printf('%.1f%% (%d/%d)', 100.0 * count(*) filter (value >= 50) / count(*), count(*) filter (value >= 50), count(*)) as pct, printf('%.3f', avg(value)) as mean from events group by event_type""")
def s34(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("k"), F.avg("value").alias("m"))
    return g.select("event_type", texts.percent_text(F.col("k"), F.col("n")).alias("pct"), texts.fixed_text("m", 3).alias("mean"))


@query("s48_date_cut", "select o_orderkey, coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') < '1996-01-01' as early from orders")
def s48(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", selection.before_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "1996-01-01").alias("early"))


@query("s29_s31_page_objects", """select page_id, 0 as at, '{"links": [{"url": "' || url || '"}], "page": ' || page_id || '}' as object from pages union all select page_id, 1, '{"url": "' || url || '"}' from pages""")
def s29(spark, sf):
    page = table(spark, sf, "pages").select("page_id", F.concat(F.lit('<script>{"page": '), F.col("page_id"), F.lit(', "links": [{"url": "'), F.col("url"), F.lit('"}]}</script>'), F.col("html")).alias("html"))
    page.createOrReplaceTempView("quern_pages")
    spark.udtf.register("quern_page_objects", pages.PageObjects)
    return spark.sql("select p.page_id, o.at, o.object from quern_pages p, lateral quern_page_objects(p.html) o")


@query("s29_script_counts", r"select page_id, len(regexp_extract_all(html, '(?i)<script[\s>]'))::int as scripts from pages")
def s29_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.script_count(F.col("html")).alias("scripts"))


@query("s30_json_objects", """select event_id, 0 as at, '{"k": ' || json_extract(props, '$.k') || '}' as object from events where props is not null""")
def s30(spark, sf):
    table(spark, sf, "events").where("props is not null").createOrReplaceTempView("quern_props")
    spark.udtf.register("quern_json_objects", nested.JsonObjects)
    return spark.sql("select e.event_id, o.at, o.object from quern_props e, lateral quern_json_objects(e.props) o")


@query("f10_f11_json_problems", r"""select doc_id, case when doc_id % 7 = 0 then '$.row.path: private key' when regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') then '$.notes[1]: e-mail address' else '' end as problems
from documents where not regexp_matches(text, '^(/Users/|/home/|/mnt/|/tmp/|file://)')""")
def f11(spark, sf):
    docs = table(spark, sf, "documents")
    private = F.to_json(F.struct(F.struct(F.col("source").alias("path"), F.lit(1).alias("n")).alias("row")))
    noted = F.to_json(F.struct(F.array(F.col("lang"), F.col("text")).alias("notes")))
    return docs.select("doc_id", F.array_join(nested.json_problems(F.when(F.col("doc_id") % 7 == 0, private).otherwise(noted)), "; ").alias("problems"))


@query("p15_nested_remap", """select event_id, '{"rows": [{"track_id": "' || case event_type when 'click' then 'new-click' when 'view' then 'new-view' else event_type end || '"}, {"n": ' || user_id || ', "track_id": "u' || user_id || '"}]}' as body from events""")
def p15(spark, sf):
    remap = nested.remap_ids({"click": "new-click", "view": "new-view"})
    rows = F.array(F.struct(F.col("event_type").alias("track_id"), F.lit(None).cast("long").alias("n")), F.struct(F.concat(F.lit("u"), "user_id").alias("track_id"), F.col("user_id").alias("n")))
    return table(spark, sf, "events").select("event_id", remap(F.to_json(F.struct(rows.alias("rows")))).alias("body"))


@query("a23_r05_chunk_audit", """with c as (select conv_id, turn, length(text) / 1000.0 as rms, case when turn % 3 = 2 then null else (length(text) % 100) / 100.0 end as prob from conversations)
select conv_id, count(*) as n_chunks, count(prob) as n_finite, round(min(20 * log10(greatest(rms, 1e-12))), 9) as min_dbfs, round(quantile_cont(20 * log10(greatest(rms, 1e-12)), 0.5), 9) as median_dbfs,
  round(max(20 * log10(greatest(rms, 1e-12))), 9) as max_dbfs, round(quantile_cont(prob, 0.5), 9) as median_prob, count(prob) >= 4 as enough from c group by conv_id""")
def a23(spark, sf):
    n = F.length("text")
    chunk = F.struct((n / 1000.0).alias("rms"), F.when(F.col("turn") % 3 != 2, (n % 100) / 100.0).alias("prob"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(chunk).alias("chunks"))
    return rounded(chunks.chunk_audit(rows, "conv_id", "chunks"))


@query("r05_weighted_probability", """select conv_id, round(sum((length(text) % 100) / 100.0::double * length(text)) / (sum(length(text)) + 1e-9), 9) as prob from conversations group by conv_id""")
def r05(spark, sf):
    n = F.length("text")
    return rounded(table(spark, sf, "conversations").groupBy("conv_id").agg(chunks.weighted_probability((n % 100) / 100.0, n.cast("double")).alias("prob")))


@query("r04_windows", """with e as (select vec_id, embedding[1:60]::double[] as e from embeddings), w as (select vec_id, i, e[i * 16 + 1:i * 16 + 16] as w from e, unnest(generate_series(0, 3)) u(i))
select vec_id, i::int as at, round(list_sum(w), 6) as total from w""")
def r04(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(chunks.windows(F.col("embedding").cast("array<double>"), 16, 60)).alias("at", "w"))
    return rows.select("vec_id", "at", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("r03_even_starts", "select doc_id, (i - 1)::int as at, ((i - 1) * greatest(n_chars - 400, 0)) // 6 as start from documents, unnest(generate_series(1, 7)) u(i)")
def r03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunks.even_starts(F.col("n_chars"), 400)).alias("at", "start"))


@query("v13_two_class_probability", "select event_id, round(1 / (1 + exp(value / 100 - 0.5)), 9) as p from events")
def v13(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", chunks.two_class_probability(F.col("value") / 100, F.lit(0.5)).alias("p")))


@query("m23_wilson_long", """with s as (select event_type, count(*) as n, count(*) filter (value >= 90) as k from events group by event_type)
select event_type, round(((k / n::double) + 3.8414588206941254 / (2 * n) - 1.959963984540054 * sqrt((k / n::double) * (1 - k / n::double) / n + 3.8414588206941254 / (4.0 * n * n))) / (1 + 3.8414588206941254 / n), 9) as lower from s""")
def m23(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 90).alias("k"))
    return rounded(s.select("event_type", intervals.wilson(F.col("k"), F.col("n"), intervals.Z_LONG)[0].alias("lower")))


@query("v04_scored_rows", r"""select doc_id, case when coalesce(text, '') <> '' then round(length(regexp_replace(text, '[\p{L}\s\x1c-\x1f\x85\xa0]', '', 'g')) / length(text)::double, 9) end as prob, case when coalesce(text, '') = '' then 'inference' end as stage from documents""")
def v04(spark, sf):
    rows = scoring.score_rows(table(spark, sf, "documents").select("doc_id", "text"), "text_shape", "doc_id")
    return rounded(rows.select("doc_id", "prob", "stage"))


@query("v16_v17_v18_v23_isolated_rows", f"""select s_suppkey, ('0x' || substr(sha256('260905:' || s_suppkey), 1, 8))::ubigint::bigint as seed, case when s_suppkey % 25 not in (3, 4) then 0.5::double end as prob,
  case when s_suppkey % 25 = 4 then 'input_execution_error' when s_suppkey % 25 = 3 then 'model_execution_error' else 'scored' end as outcome,
  case when s_suppkey % 25 = 3 then 'TimeoutExpired' when s_suppkey % 25 = 4 then 'OSError' end as error_type from supplier""")
def v16(spark, sf):
    return scoring.score_isolated(table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).alias("k")), "slow_or_broken", "s_suppkey", 1.5).drop("error")


@query("p25_creator_alias", """select c_custkey, case when c_custkey % 2 = 0 then 'suno:@' || lower(c_name) else 'udio:artist:' || lower(c_name) end as alias from customer""")
def p25(spark, sf):
    from ..operators.projections import creator_alias

    provider = F.when(F.col("c_custkey") % 2 == 0, "suno").otherwise("udio")
    return table(spark, sf, "customer").select("c_custkey", creator_alias(provider, F.concat(F.lit("@@"), F.col("c_name")), F.concat(F.lit(" "), F.col("c_name"), F.lit("  "))).alias("alias"))


def _drain(spark, stream, mode: str):
    """Run a stream over what is there and return its result table."""
    base = f"{shared_dir(spark)}/quern-stream-{uuid.uuid4().hex}"
    return ledger.drained(stream, f"{base}/out", f"{base}/checkpoint", mode)


def _event_stream(spark, sf):
    """The events as a stream of one file each batch."""
    batch = table(spark, sf, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(sf) if sf.startswith("/") else None


@query("x04_stream_latest", "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by user_id")
def x04(spark, sf):
    stream = _event_stream(spark, sf).select("user_id", "event_id", "event_type")
    return _drain(spark, ledger.latest(stream, "user_id", "event_id"), "complete").select("user_id", "event_id", "event_type")


@query("x03_stream_pending", "select event_id from events where user_id not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def x03(spark, sf):
    done = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return _drain(spark, ledger.pending(_event_stream(spark, sf), done, "user_id").select("event_id"), "append")


@query("x01_x02_idempotent_append", "select count(*) as n, sum(event_id)::bigint as s from events")
def x01(spark, sf):
    base = f"{shared_dir(spark)}/quern-append-{uuid.uuid4().hex}"
    ledger.append_idempotent(_event_stream(spark, sf).select("event_id"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.schema(T.StructType([T.StructField("event_id", T.LongType())])).option("recursiveFileLookup", True).parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))


@query("x06_x07_breaker", """with e as (select event_type as key, event_id, (value < 10)::int as f from events), g as (select *, sum(1 - f) over (partition by key order by event_id) as run from e),
r as (select key, run, sum(f) as n from g group by key, run), l as (select key, max(run) as run from g group by key)
select r.key, (select count(*) from e where e.key = r.key) as seen, max(r.n) filter (r.run = l.run)::bigint as failures, max(r.n) >= 5 as open from r join l on r.key = l.key group by r.key""")
def x06(spark, sf):
    stream = _event_stream(spark, sf).select("event_type", (F.col("value") < 10).alias("failed"), "event_id")
    return _drain(spark, ledger.breaker(stream, "event_type", "failed", "event_id"), "update")


@query("x08_windowed_rates", """select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, count(*) filter (value >= 50) as k from events group by 1, 2""")
def x08(spark, sf):
    stream = _event_stream(spark, sf).withColumn("hit", F.col("value") >= 50).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(spark, ledger.windowed_rates(stream, "ts", "event_type", "hit"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
