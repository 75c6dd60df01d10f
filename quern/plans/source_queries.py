"""Sources and sinks: tables written in each format and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing
from ..operators import joins, projections
from ..sources import manifests, records, sinks
from ..storage import shared_dir
from .base import cohort, cohort_sql, rounded, table
from .catalog import query

C = cohort_sql()


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


def _put(spark, path: str, data: bytes) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()


def _suppliers(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("t"), k).alias("track_id"), F.concat(F.lit("n"), "s_nationkey").alias("source"), F.when(k % 4 != 0, F.when(k % 2 == 0, "new").otherwise("old")).alias("bench_origin"),
        (F.round("s_acctbal", 2)).alias("balance"),
    )


@query("c01_f01_manifest_file", "select 't' || s_suppkey as track_id, 'n' || s_nationkey as source, round(s_acctbal, 2) as balance from supplier where s_suppkey % 4 <> 0 and s_suppkey % 2 = 0")
def c01(spark, sf):
    path = _path(spark, "manifest")
    manifests.write_manifest(_suppliers(spark, sf), path)
    return manifests.read_manifest(spark, path, bench_origin="new").select("track_id", "source", "balance")


@query("c02_audit_rows", "select 't' || s_suppkey as track_id, (row_number() over (order by 't' || s_suppkey) - 1)::int as ordinal from supplier")
def c02(spark, sf):
    path = _path(spark, "manifest")
    manifests.write_manifest(_suppliers(spark, sf), path, "tracks")
    return manifests.audit_rows(spark, path).select("track_id", "ordinal")


@query("c16_split_rows", "select case when s_suppkey % 4 = 0 then 'train' when s_suppkey % 4 = 1 then 'val' when s_suppkey % 4 = 2 then 'test' else 'bench' end as split, count(*) as n from supplier group by 1")
def c16(spark, sf):
    path, k = _path(spark, "splits"), F.substring("track_id", 2, 20).cast("long") % 4
    parts = [F.array_sort(F.collect_list(F.when(k == i, F.struct("track_id", "source")))).alias(name) for i, name in enumerate(manifests.ALL_SPLITS)]
    _suppliers(spark, sf).agg(F.to_json(F.struct(*parts)).alias("value")).write.text(path)
    return manifests.split_rows(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _run_files(spark, sf) -> str:
    folder = _path(spark, "run")
    rows = cohort(spark, sf).withColumn("track_id", F.col("track_id").cast("string"))
    scored = rows.where("prob is not null").select("track_id", "source", "label", "prob", F.when(F.col("lang") != "es", F.col("prob") >= 0.5).alias("decision_ai"))
    manifests.write_rows(scored, f"{folder}/track_probs.json")
    manifests.write_rows(rows.where("stage = 'inference'").select("track_id", "source", "stage", F.lit("ValueError").alias("error_type"), F.lit("lost").alias("error")), f"{folder}/inference_failures.json")
    return folder


@query("c04_c36_c41_run_files", f"""with {C} select track_id::varchar as track_id, label, prob, case when lang <> 'es' then prob >= 0.5 end as decision_ai, null as error from cohort where prob is not null
union all select track_id::varchar, null, null, null, 'lost' from cohort where stage = 'inference'""")
def c04(spark, sf):
    scores, failures = manifests.read_run(spark, _run_files(spark, sf))
    one = scores.select("track_id", "label", "prob", "decision_ai", F.lit(None).cast("string").alias("error"))
    return one.unionByName(failures.select("track_id", "error"), allowMissingColumns=True)


@query("c40_decisions_of_whole_runs", f"with {C} select 0 as whole, count(*) filter (false) as n from cohort union all select 1, count(*) from cohort where prob is not null and lang <> 'es'")
def c40(spark, sf):
    scores, _ = manifests.read_run(spark, _run_files(spark, sf))
    some, every = manifests.decisions(scores), manifests.decisions(scores.where("decision_ai is not null"))
    return some.agg(F.lit(0).alias("whole"), F.count(F.lit(1)).alias("n")).unionByName(every.agg(F.lit(1).alias("whole"), F.count(F.lit(1)).alias("n")))


@query("c35_c42_several_runs", f"with {C} select source, count(*) as n, round(avg(prob), 9) as mean from cohort where prob is not null group by source")
def c35(spark, sf):
    folder = _run_files(spark, sf)
    both = manifests.read_results(spark, {"here": f"{folder}/track_probs.json", "gone": f"{folder}/no_such_file.json"})
    return rounded(both.where("model = 'here'").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean")))


@query("c07_c08_c09_index_lines", "select l_suppkey::varchar as shard, count(*) as n, sum(l_orderkey)::bigint as s from lineitem group by 1")
def c07(spark, sf):
    path = _path(spark, "index")
    members = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.lit("file").alias("type"), F.col("l_suppkey").cast("string").alias("shard"), F.col("l_orderkey").alias("size"))
    records.write_index(members, path)
    back = records.read_index(spark, path)
    return back.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))


@query("c10_k04_k06_ledger", "select o_orderkey::varchar as path, case when o_orderkey % 3 = 0 then -1 else o_custkey end as size from orders")
def c10(spark, sf):
    path, o = _path(spark, "ledger"), table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"))
    records.write_lines(o.coalesce(1), f"{path}/a")
    records.write_lines(o.where("cast(path as long) % 3 = 0").withColumn("size", F.lit(-1).cast("long")).coalesce(1), f"{path}/b")
    return records.read_ledger(spark, f"{path}/*", T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())]))


@query("c11_title_index", "select lower(c_name) as title, 'artist ' || c_nationkey as artist, c_custkey as id from customer")
def c11(spark, sf):
    path = _path(spark, "titles")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("track_"), "c_custkey").alias("TRACK_ID"), F.concat(F.lit(" "), F.upper("c_name")).alias("TRACK_NAME"), F.concat(F.lit("Artist   "), "c_nationkey").alias("ARTIST_NAME"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return manifests.read_title_index(spark, path)


@query("c12_c15_id_lists", "select 'fma' as kind, c_custkey::varchar as id from customer union all select 'mtg', p_partkey::varchar from part")
def c12(spark, sf):
    base = _path(spark, "ids")
    table(spark, sf, "customer").select(F.concat(F.lit("/x/00/"), "c_custkey", F.lit(".mp3"))).coalesce(1).write.text(f"{base}/fma")
    table(spark, sf, "part").select(F.concat("p_partkey", F.lit(".low.mp3"))).coalesce(1).write.text(f"{base}/mtg")
    return manifests.read_references(spark, {"pool": {"fma": f"{base}/fma", "mtg": f"{base}/mtg"}})


@query("c13_c14_lineage_manifests", "select 'fma' as kind, count(*) as n from supplier where s_suppkey % 2 = 0 union all select 'mtg', count(*) from supplier where s_suppkey % 2 = 1")
def c13(spark, sf):
    base, k = _path(spark, "lineage"), F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("cell:fma_full:"), k)).otherwise(F.concat(F.lit("/d/mtg-jamendo/"), k, F.lit(".low.mp3")))
    rows = table(spark, sf, "supplier").select(name.alias("path"), F.lit("x").alias("track_id"))
    manifests.write_manifest(rows, f"{base}/one", "train", "path")
    manifests.write_manifest(rows, f"{base}/two", "tracks", "path")
    return manifests.identity_sets(manifests.read_lineage(spark, [f"{base}/one", f"{base}/two"]))


@query("c17_c18_c19_listings", "select n_nationkey::bigint as id, 'd' || n_regionkey || '/' || n_nationkey || '.mp3' as path, length(n_name)::bigint + 1 as size from nation")
def c17(spark, sf):
    base = _path(spark, "files")
    # One file for each row of a small table, named as audio files are.
    for region, key, name in table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name").collect():
        _put(spark, f"{base}/d{region}/{key}.mp3", f"{name}\n".encode())
    listed = records.list_files(spark, base, "*.mp3")
    found = records.files_by_id(listed, [f"d{i}" for i in range(5)]).join(records.sizes_by_stem(listed).select(F.col("stem").cast("long").alias("id"), "size"), "id")
    return found.select("id", F.substring_index("path", "/", -2).alias("path"), "size")


@query("c37_k20_cohort_files", f"with {C} select count(*) as n, sha256(string_agg(track_id::varchar, chr(10) order by track_id::varchar)) as digest from cohort where split = 'test'")
def c37(spark, sf):
    path = _path(spark, "cohort")
    ids = cohort(spark, sf).where("split = 'test'").select(F.col("track_id").cast("string").alias("track_id"))
    ids.agg(F.to_json(F.struct(F.collect_list("track_id").alias("track_ids"))).alias("value")).write.text(path)
    return sinks.describe_ids(manifests.read_cohort(spark, path), path).select("n", "digest")


@query("c38_s43_path_mappings", "select s_suppkey::varchar as id, '/data/' || s_name as path from supplier")
def c38(spark, sf):
    path = _path(spark, "mapping")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.concat(F.lit("/data/"), "s_name"))))
    table(spark, sf, "supplier").agg(F.to_json(pairs).alias("value")).write.text(path)
    return manifests.read_mapping(spark, path)


@query("c44_w17_frozen_membership", "select track_id, source, rank from (select 't' || s_suppkey as track_id, 'n' || s_nationkey as source, sha256('260905:t' || s_suppkey) as rank from supplier) qualify row_number() over (partition by source order by rank) <= 2")
def c44(spark, sf):
    from ..operators.selection import top_per_group

    rows = _suppliers(spark, sf).select("track_id", "source", "balance")
    frozen = manifests.read_frozen(rows, rows.select("track_id", "source"), ["source"], "track_id")
    return top_per_group(frozen, ["source"], [F.col("rank")], 2).select("track_id", "source", "rank")


@query("k02_k03_k07_files", f"with {C} select source as model, 'mean' as metric, round(avg(prob), 6) as estimate from cohort where prob is not null group by source")
def k02(spark, sf):
    path = _path(spark, "metrics")
    long = cohort(spark, sf).where("prob is not null").groupBy(F.col("source").alias("model")).agg(F.lit("mean").alias("metric"), F.round(F.avg("prob"), 6).alias("estimate"))
    sinks.write_metrics_csv(long, path)
    return spark.read.option("header", True).csv(path).select("model", "metric", F.col("estimate").cast("double").alias("estimate"))


@query("k05_index_shards_again", "select l_suppkey::varchar as shard, count(*) as n from lineitem group by 1")
def k05(spark, sf):
    path = _path(spark, "index")
    members = table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.col("l_suppkey").cast("string").alias("shard"))
    for _ in range(2):  # writing it again changes nothing
        records.write_index(members, path)
    return records.read_index(spark, path).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("k08_model_folders", f"with {C} select lang as model, count(*) as n, round(sum(prob), 6) as s from cohort group by lang")
def k08(spark, sf):
    path = _path(spark, "models")
    rows = cohort(spark, sf).select(F.col("lang").alias("model"), "track_id", "prob")
    sinks.write_by_model(rows, path)
    return rounded(spark.read.schema(rows.schema).parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("s")), 6)


@query("k09_k10_public_files", f"with {C} select 'mb_' || substr(sha1(track_id::varchar), 1, 16) as id, case when prob is not null then 'scored' else 'failed' end as outcome, prob, case when prob is null then stage end as error from cohort")
def k09(spark, sf):
    path = _path(spark, "public")
    rows = cohort(spark, sf).select("track_id", F.when(F.col("prob").isNotNull(), "scored").otherwise("failed").alias("outcome"), "prob", F.col("stage").alias("error"), F.lit("/x").alias("path"))
    ids = cohort(spark, sf).select("track_id", hashing.short_id("track_id", "mb_", 16, "sha1").alias("public_id"))
    public = projections.prediction_rows(projections.remapped(rows, ids).withColumnRenamed("track_id", "id"))
    sinks.write_once(public, path)
    return spark.read.schema(public.schema).parquet(path)


@query("k01_write_once", "select true as written, false as written_again, 500 as rows from supplier having count(*) > 0")
def k01(spark, sf):
    path = _path(spark, "once")
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    first, second = sinks.write_once(rows, path), sinks.write_once(rows, path)
    n = spark.read.schema(rows.schema).parquet(path)
    return n.agg(F.lit(first).alias("written"), F.lit(second).alias("written_again"), F.count(F.lit(1)).cast("int").alias("rows"))


@query("k13_k14_k15_archives", "select source as bundle, count(*) as files, sum(length(doc_id || ''))::bigint as bytes from documents group by source")
def k13(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("bundle"), F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".txt"))).alias("file"), F.col("doc_id").cast("string").alias("content"))
    back = sinks.extracted(sinks.bundled(files))
    return back.groupBy("bundle").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


@query("k18_source_snapshot", "select sha256(p_name) as digest, min(p_partkey) as first, count(*) as copies from part group by 1")
def k18(spark, sf):
    files = table(spark, sf, "part").select(hashing.sha256_hex("p_name").alias("digest"), "p_partkey")
    found = joins.content_match(files, files.select("digest", F.col("digest").alias("key")).distinct(), "digest", "p_partkey", "key")
    return found.select("digest", F.col("bound_path").alias("first"), "copies")


@query("c20_s23_s24_s26_s27_tar_members", "select 'd' || n_regionkey || '/é' || repeat('x', 120) || n_name || '.txt' as path, length(n_name)::bigint as size, 'file' as type from nation")
def c20(spark, sf):
    import io
    import tarfile

    path = _path(spark, "shard") + ".tar"
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for region, name in table(spark, sf, "nation").select("n_regionkey", "n_name").collect():
            info = tarfile.TarInfo(f"d{region}/é{'x' * 120}{name}.txt")  # too long and wide for a plain header
            info.size = len(name)
            tar.addfile(info, io.BytesIO(name.encode()))
    _put(spark, path, out.getvalue())
    return records.read_tar_members(spark, [path]).select("path", "size", "type")
