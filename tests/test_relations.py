import hashlib
import json
import sys
import tarfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quern.functions import hashing, nested, pages, texts, urls
from quern.operators import catalogue, chunks, constraints, graph, joins, projections, scoring, selection, similarity
from quern.sources import manifests, records, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rank(key, seed="260905"):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


# --- selection ------------------------------------------------------------------

def test_draw_is_order_free(spark):
    rows = [(f"t{i}", f"s{i % 2}") for i in range(20)]
    a = spark.createDataFrame(rows, "track_id string, source string")
    b = spark.createDataFrame(rows[::-1], "track_id string, source string").repartition(3)
    assert set(selection.drawn_per_source(a, 7).collect()) == set(selection.drawn_per_source(b, 7).collect())
    assert selection.drawn_per_source(a, 7).count() == 14 and selection.drawn_per_source(a, 0).count() == 20


def test_capped_sample(spark):
    rows = spark.createDataFrame([(f"t{i}", f"C{i // 4}", v) for i in range(12) for v in range(2)], "track string, owner string, variant int")
    got = selection.capped_sample(rows, 100, "owner", "track")
    assert got.count() == 12 and got.select("track").distinct().count() == 6
    want = [t for c in range(3) for t in sorted((f"t{i}" for i in range(4 * c, 4 * c + 4)), key=rank)[:2]]
    assert {r["track"] for r in got.collect()} == set(want)


def greedy(rows, cap, quota):
    per_owner, per_provider, out = {}, {}, {}
    for key, provider, owner, bad in sorted(rows, key=lambda r: (rank(r[0]), r[0])):
        if bad:
            out[key] = "rule"
        elif per_owner.get((provider, owner), 0) >= cap:
            out[key] = "owner_cap"
        elif per_provider.get(provider, 0) >= quota:
            out[key] = "provider_quota"
        else:
            out[key] = "selected"
            per_owner[provider, owner] = per_owner.get((provider, owner), 0) + 1
            per_provider[provider] = per_provider.get(provider, 0) + 1
    return out


@pytest.mark.parametrize("cap,quota", [(2, 10), (1, 50), (3, 5)])
def test_quota_equals_a_sequential_pass(spark, cap, quota):
    rows = [(f"k{i}", "p" if i % 3 else "q", f"o{i % 11}", i % 7 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, provider string, owner string, bad boolean")
    got = selection.quota_selection(df, [("rule", F.col("bad"))], "provider", "owner", "key", cap, quota)
    assert {r["key"]: r["reason"] for r in got.collect()} == greedy(rows, cap, quota)


def test_balanced_rounds(spark):
    rows = [(f"{s}{i}", s, f"{s}g{i // 2}") for s in "abc" for i in range(10)]
    df = spark.createDataFrame(rows, "id string, source string, grp string")
    got = selection.balanced_rounds(df, "source", "grp", "id", 8).collect()
    counts = sorted(sum(r["source"] == s for r in got) for s in "abc")
    assert len(got) == 8 and counts == [2, 3, 3] and len({r["grp"] for r in got}) == 8


def test_runs(spark):
    values = [1.0, 1.0, 0.2, 1.0, 0.2, 1.0, 1.0]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    assert [(r["start"], r["end"]) for r in selection.runs(df, ["k"], "i", F.col("v"), 0.985).orderBy("start").collect()] == [(0, 10), (25, 35)]


def test_budget_fill_skips_and_goes_on(spark):
    rows = [("a1", "a", 5), ("a2", "a", 50), ("a3", "a", 4), ("b1", "b", 3), ("c1", "c", 6)]
    df = spark.createDataFrame([(p, g, p, n) for p, g, n in rows], "path string, g string, family string, size int")
    got = {r["path"] for r in selection.budget_fill(df, [{"a": 3, "b": 3}, {"c": 1}], 12, "g", "family", "path", "size").collect()}
    assert got == {"a1", "a3", "b1"}


def test_contiguity(spark):
    df = spark.createDataFrame([("s", 0, 100), ("s", 512, 600), ("s", 1536, 1), ("s", 2560, 1)], "shard string, off long, size long")
    assert [r["off"] for r in selection.contiguity(df, "shard", "off", "size").collect()] == [2560]


# --- joins and sets -----------------------------------------------------------------

def test_duplicate_lines_are_errors(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    lines = spark.createDataFrame([(1, 0.5), (1, 0.6)], "k long, p double")
    with pytest.raises(Exception, match="duplicate line"):
        joins.three_way(rows, lines, "k").collect()
    got = {r["k"]: r["matched"] for r in joins.three_way(rows, spark.createDataFrame([(2, 0.1), (3, 0.2)], "k long, p double"), "k").collect()}
    assert got == {1: "row_only", 2: "both", 3: "line_only"}


def test_merge_and_cover(spark):
    ids = spark.range(6).withColumnRenamed("id", "k")
    got = {r["key"]: r["status"] for r in joins.merge_shards(ids, [ids.where("k < 3"), spark.createDataFrame([(2,), (9,)], "k long")], "k").collect()}
    assert got == {0: "ok", 1: "ok", 2: "duplicate", 3: "missing", 4: "missing", 5: "missing", 9: "extra"}
    cover = {r["problem"]: r["n"] for r in joins.exact_cover(ids, ids.where("k < 4"), ids.where("k in (3, 4)").union(spark.createDataFrame([(77,)], "k long")), "k").collect()}
    assert cover == {"scored_and_failed": 1, "neither": 1, "outside_cohort": 1}


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 2), (4, "z", 1)], "k int, f string, g int")
    got = {r["key"]: (r["side"], r["fields"]) for r in joins.compare_tables(a, b, "k", ["f", "g"]).collect()}
    assert got == {1: ("equal", ""), 2: ("conflict", "f,g"), 3: ("left_only", ""), 4: ("right_only", "")}


# --- graphs ------------------------------------------------------------------------

def test_components_against_union_find(spark):
    import random

    random.seed(4)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}


def test_labels_do_not_depend_on_order(spark):
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    one_way = graph.group_labels(keys, spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"), "r:")
    other = graph.group_labels(keys, spark.createDataFrame([("c", "a"), ("b", "a")], "a string, b string"), "r:")
    first = {r["key"]: r["label"] for r in one_way.collect()}
    assert first == {r["key"]: r["label"] for r in other.collect()}
    assert first["a"] == "r:" + hashlib.sha256(b"a\nb\nc").hexdigest()[:24] and first["d"] != first["a"]


def test_owner_exposure(spark):
    rows = spark.createDataFrame([(1, "x", "u"), (2, "y", "u"), (3, "z", "v"), (4, "x", None)], "id int, al string, owner string")
    got = {r["id"]: r["exposed"] for r in graph.exposed_by_owner(rows, "al", "owner", spark.createDataFrame([("x",)], "alias string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


# --- similarity -----------------------------------------------------------------------

def test_shifted_copy_is_found(spark):
    import random

    random.seed(1)
    a = [random.getrandbits(32) for _ in range(130)]
    b = [random.getrandbits(32) for _ in range(10)] + [x ^ 1 for x in a[:120]]
    c = [random.getrandbits(32) for _ in range(130)]
    rows = spark.createDataFrame([(0, a), (1, b), (2, c)], "k long, fp array<long>")
    got = similarity.copy_candidates(rows, "k", "fp", votes=1).collect()
    assert [(r["a"], r["b"], r["offset"], r["bit_error"]) for r in got] == [] or got[0]["bit_error"] == 1 / 32
    exact = spark.createDataFrame([(0, a), (1, [7] * 10 + a[:120]), (2, c)], "k long, fp array<long>")
    (r,) = similarity.copy_candidates(exact, "k", "fp").collect()
    assert (r["a"], r["b"], r["offset"], r["bit_error"], r["frames"]) == (0, 1, -10, 0.0, 120)


def test_block_links_against_brute_force(spark):
    import random

    random.seed(2)
    base = [random.getrandbits(64) for _ in range(20)]
    values = [(i, b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(5)))) for i, b in enumerate(base * 4)]
    signed = [(i, v - 2**64 if v >> 63 else v) for i, v in values if v < 2**64]
    got = {(r["a"], r["b"]) for r in similarity.block_links(spark.createDataFrame(signed, "k long, bits long"), "k", "bits", 3).collect()}
    stands = {}
    for i, v in values:
        stands.setdefault(v, i)
    want = {(i, j) for v, i in stands.items() for w, j in stands.items() if i < j and (v ^ w).bit_count() <= 3}
    assert got == want | {(stands[v], i) for i, v in values if stands[v] != i}


# --- members and texts ---------------------------------------------------------------------

MEMBERS = [
    ("Jamendo/A - B.mp3", ("human", "human_jamendo", "clean", "jamendo", "A - B", None)),
    ("OOD FMA/12.mp3.wav", ("human", "human_fma_ood", "clean", "fma", "12", None)),
    ("suno_generated_music/x.wav", ("ai", "suno", "clean", "none", "x", None)),
    ("MusicGen_generated_music/Genius-Lyrics/s.wav", ("ai", "musicgen", "clean", "genius", "s", None)),
    ("mp3_noised_music/udio_generated_music/root/u_mp364.wav", ("ai", "udio__mp3", "mp3", "none", "u", "mp364")),
    ("pitch_time_generated_music/magnet_generated_music/jamedo/m_pt-ps+2st-ts1.1.wav", ("ai", "magnet__pitch_time", "pitch_time", "jamendo", "m", "pt-ps+2st-ts1.1")),
    ("pgd_generated_music/magnet_generated_music/adv_k.wav", ("ai", "magnet__pgd", "pgd", "*", "k", "pgd")),
    ("ai_human_co-created_music/jamendo/q_edited.mp3", ("ai", "co_created", "co_created", "jamendo", "q", None)),
    ("Caption/a.csv", ("meta", None, None, None, None, None)), ("README.md", (None,) * 6), ("mp3_noised_music/udio_generated_music/root/u.wav", (None,) * 6),
]


def test_members(spark):
    df = catalogue.classified(spark.createDataFrame([(p,) for p, _ in MEMBERS], "path string"))
    got = {r["path"]: (r["kind"], r["group"], r["variant"], r["caption_set"], r["base_key"], r["transform_param"]) for r in df.collect()}
    assert got == dict(MEMBERS)


def test_title_cuts(spark):
    rows = spark.createDataFrame([("x", "Song - Part 2 - The ARTIST"), ("y", "No cut")], "key string, name string")
    ref = spark.createDataFrame([("song  -  part 2", "the artist", 7), ("Song", "Part 2 - the &amp; artist", 8), ("song", "part 2 - The Artist", 9)], "title string, artist string, id long")
    assert {(r["key"], r["id"]) for r in catalogue.title_matches(rows, ref, "key", "name").collect()} == {("x", 7), ("x", 9)}


@pytest.mark.parametrize("text,want", [("A &amp;  B ", "a & b"), ("ﬁne  Straße", "fine strasse"), ("", ""), ("TAB\tx\n", "tab x"), (None, None)])
def test_fold_text(spark, text, want):
    assert one(spark, texts.fold_text(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("path,ok", [("a/b.mp3", True), ("/a", False), ("a/../b", False), ("a//b", False), ("a\\b", False), ("", False), ("./a", False)])
def test_safe_paths(spark, path, ok):
    assert one(spark, texts.safe_relative_path(F.lit(path))) is ok


def test_urls(spark):
    key = lambda u: one(spark, urls.url_key(F.lit(u)))
    assert key("HTTPS://Host.example/a?x=1#f") == "https://host.example/a?x=1" and key("https://u:p@h.example/") is None
    assert one(spark, urls.public_url_problem(F.lit("https://h.example/a?q=1"))) == "query" and one(spark, urls.public_url_problem(F.lit("http://h.example/"))) == "not_https"
    ids = one(spark, urls.lineage_tokens(F.lit("https://s.example/song/" + "Ab" * 16), F.lit("suno")))
    assert ids == ["suno:" + "ab" * 16] and one(spark, urls.lineage_tokens(F.lit("0" * 32), F.lit("suno"))) == []


def test_hashes(spark):
    assert one(spark, hashing.rank_key(F.lit("k"))) == rank("k") and one(spark, hashing.record_seed(F.lit("k"))) == int(hashlib.sha256(b"k").hexdigest()[:8], 16)
    df = spark.createDataFrame([("b",), ("a",)], "id string")
    assert df.agg(hashing.joined_digest(F.col("id"), ending="\n").alias("x")).first()["x"] == hashlib.sha256(b"a\nb\n").hexdigest()


# --- nested JSON, pages, scoring -----------------------------------------------------------

def test_private_json(spark):
    rows = ['{"a": [{"runtime_path": 1}]}', '{"a": "/Users/x"}', '{"a": "me@host.example"}', '{"artist": "x"}', '{"a": 1, "a": 2}', "{", '{"ok": [1]}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    got = {r["i"]: len(r["p"]) for r in df.select("i", nested.json_problems("j").alias("p")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


def test_page_objects():
    body = json.dumps({"song": {"id": "é"}})
    lyric = '{"not": "parsed"}é'
    stream = f"1:{body}\n2:T{len(lyric.encode()):x},{lyric}3:[{{\"k\": 1}}]\n"
    cut = len(stream) // 2
    page = '<script type="x">{"a": [{"b": 1}]}</script><script>var x = [1</script>' + "".join(f"<script>self.__next_f.push({json.dumps([1, s])})</script>" for s in (stream[:cut], stream[cut:]))
    got = list(pages.page_objects(page))
    assert {"b": 1} in got and {"id": "é"} in got and {"k": 1} in got and {"not": "parsed"} not in got
    with pytest.raises(ValueError):
        list(pages.page_objects('<script>self.__next_f.push([1, "1:{}"])</script>'))


class Fussy:
    def load(self):
        self.loaded = True

    def score(self, batch):
        if (batch["x"] == 3).any():
            raise RuntimeError("three")
        return batch["x"].to_numpy() / 4.0


def test_scorer_keeps_every_failure(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module
    scoring.REGISTRY["fussy"] = Fussy
    rows = spark.createDataFrame([(i, i) for i in range(6)], "id long, x long").coalesce(1)
    got = {r["id"]: (r["prob"], r["stage"]) for r in scoring.score_rows(rows, "fussy", "id").collect()}
    assert got == {0: (0.0, None), 1: (0.25, None), 2: (0.5, None), 3: (None, "inference"), 4: (1.0, None), 5: (None, "inference")}
    with pytest.raises(KeyError):
        scoring.build("absent")


def test_windows_of_a_signal(spark):
    signal = F.lit([float(i) for i in range(22)])
    got = one(spark, chunks.windows(signal, 8, 22))
    assert [len(w) for w in got] == [8, 8, 8] and got[2][-2:] == [0.0, 0.0]
    assert len(one(spark, chunks.windows(F.lit([1.0] * 19), 8, 19))) == 2
    assert one(spark, chunks.even_starts(F.lit(100), 40)) == [0, 10, 20, 30, 40, 50, 60]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "x", "mail me@host.example"), (2, "", "see https://a@b.example/home/x"), (3, None, "/home/me")], "id int, f string, t string")
    assert {(r["key"], r["rule"]) for r in constraints.violations(df, "id", constraints.required("f")).collect()} == {("2", "f is required"), ("3", "f is required")}
    assert {r["key"] for r in constraints.private_text(df, "id", ["t"]).collect()} == {"1", "3"}
    assert constraints.closed_schema(df, {"id", "f", "z"}) == ["unexpected: t", "absent: z"]


# --- sources and sinks ------------------------------------------------------------------------

def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_manifest_layouts(spark, tmp_path):
    a = write(tmp_path / "a.json", {"tracks": [{"track_id": "1", "bench_origin": "test"}, {"track_id": "2", "bench_origin": "train"}]})
    b = write(tmp_path / "b.json", {"train": [{"track_id": "1"}], "test": [{"track_id": "2", "x": 1}]})
    assert manifests.read_manifest(spark, a, split="train").count() == 2 and manifests.read_manifest(spark, a, bench_origin="test").count() == 1
    assert [r["track_id"] for r in manifests.read_manifest(spark, b, split="test").collect()] == ["2"] and manifests.read_manifest(spark, b).count() == 2
    assert manifests.audit_rows(spark, b).count() == 1
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, write(tmp_path / "c.json", {"other": []}))


def test_cohorts(spark, tmp_path):
    assert manifests.read_cohort(spark, write(tmp_path / "a.json", ["x", "y"])).count() == 2
    assert manifests.read_cohort(spark, write(tmp_path / "b.json", {"track_ids": ["x"]})).count() == 1
    for bad in (["x", "x"], [], {"other": 1}):
        with pytest.raises(Exception):
            manifests.read_cohort(spark, write(tmp_path / "c.json", bad)).collect()


def test_ledger_last_entry_wins(spark, tmp_path):
    lines = [{"path": "a", "size": 1}, {"path": "b", "size": 1}, {"path": "a", "size": 2}]
    path = write(tmp_path / "l.jsonl", "\n".join(map(json.dumps, lines)) + '\n{"path": "b", "si')
    got = records.read_ledger(spark, path, records.T.StructType([records.T.StructField("path", records.T.StringType()), records.T.StructField("size", records.T.LongType())]))
    assert {r["path"]: r["size"] for r in got.collect()} == {"a": 2, "b": 1}


def test_title_index_ids_and_lineage(spark, tmp_path):
    tsv = write(tmp_path / "m.tsv", "TRACK_ID\tTRACK_NAME\tARTIST_NAME\ntrack_0007\tSong\tThe  Artist\nshort\n")
    assert [tuple(r) for r in manifests.read_title_index(spark, tsv).collect()] == [("song", "the artist", 7)]
    assert {r["id"] for r in manifests.read_id_list(spark, write(tmp_path / "i.txt", "a/12.mp3\n\nx.mp3\n0034_x.mp3\n")).collect()} == {12, 34}
    assert {r["id"] for r in manifests.read_id_list(spark, write(tmp_path / "i.json", ["5.mp3", {"path": "x/6.mp3"}])).collect()} == {5, 6}
    lin = write(tmp_path / "lin.json", {"train": [{"path": "/x/fma_full/000/12.mp3"}, {"track_id": "cell:c:s:fake_1_suno_0"}], "val": [{"path": "/mtg-jamendo/9.low.mp3"}]})
    assert {(r["kind"], r["id"]) for r in manifests.read_lineage(spark, [lin]).collect()} == {("fma", "12"), ("sonics", "fake_1_suno_0"), ("mtg", "9")}


def test_tar_members(spark, tmp_path):
    shard = tmp_path / "s0.tar"
    with tarfile.open(shard, "w") as tar:
        for name, body in (("d/" + "n" * 120 + ".wav", b"x" * 700), ("b.mp3", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            import io

            tar.addfile(info, io.BytesIO(body))
    got = {r["path"]: r for r in records.read_tar_members(spark, [str(shard)]).collect()}
    assert got["b.mp3"]["size"] == 0 and got["d/" + "n" * 120 + ".wav"]["size"] == 700 and all(r["shard"] == "s0.tar" for r in got.values())


def test_listing_and_sinks(spark, tmp_path):
    (tmp_path / "f").mkdir()
    write(tmp_path / "f" / "x.txt", "hello")
    (r,) = records.file_digests(spark, str(tmp_path / "f")).collect()
    assert r["sha256"] == hashlib.sha256(b"hello").hexdigest() and records.list_files(spark, str(tmp_path / "f")).first()["stem"] == "x"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.write_once(df, str(tmp_path / "once")) and not sinks.write_once(df.repartition(3), str(tmp_path / "once"))
    with pytest.raises(sinks.Differs):
        sinks.write_once(df.where("k = 1"), str(tmp_path / "once"))
    sinks.write_metrics_csv(spark.createDataFrame([("m", "F1", 0.5)], "model string, metric string, estimate double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[:4] == ["model", "scope", "cohort", "metric"]


def test_keyed_copies(spark):
    df = spark.createDataFrame([(1, True, False)], "id int, seen boolean, seen_m boolean")
    assert projections.keyed(df, ["seen"], "m").first()["seen_m"] is True


def test_title_matches_shuffle_no_pairs(spark):
    """Equal names match in pairs; only ids with several titles need their pairs made distinct."""
    rows = spark.createDataFrame([("x", "a - b - c"), ("x", "a - b - c"), ("x", "a - b"), ("y", "a - b"), (None, "a - b")], "key string, name string")
    ref = spark.createDataFrame([("A", "b", 1), ("a", "B", 1), ("a", "b - c", 2), ("a", "b", 2), ("a", "b", None), ("q", "b", 3)], "title string, artist string, id long")
    found = catalogue.title_matches(rows, ref, "key", "name")
    wanted = [(k, i) for k in ("x", "y", None) for i in (1, 2, None)]
    assert sorted(map(repr, ((r["key"], r["id"]) for r in found.collect()))) == sorted(map(repr, wanted))
    many = spark.range(300).select(F.col("id").alias("key"), F.lit("a - b").alias("name"))
    plain = catalogue.title_matches(many, spark.range(300).select(F.lit("a").alias("title"), F.lit("b").alias("artist"), "id"), "key", "name")
    # The one aggregate over joined pairs is that of ids with several titles.
    plan = plain._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plain.count() == 90_000 and plan[0].startswith("Union") and sum(line.lstrip(" :+-").startswith("Aggregate [key") and "id" in line.split("]")[0] for line in plan) == 1


def test_title_matches_are_stored_in_little_space(spark, tmp_path, monkeypatch):
    """Pairs of equal names are written run by run, so files need much less than a number for each; runs change no pair."""
    many = spark.range(1_500).select(F.xxhash64("id").alias("key"), F.lit("a - b").alias("name"))
    ref = spark.range(1_500).select(F.lit("a").alias("title"), F.lit("b").alias("artist"), F.xxhash64(F.col("id") + 9).alias("id"))
    catalogue.title_matches(many, ref, "key", "name").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 1_500**2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1_500**2 / 2
    monkeypatch.setattr(catalogue, "RUN", 3)
    monkeypatch.setattr(catalogue, "PIECE", 2)
    rows = spark.createDataFrame([(k, n) for k in [*range(7), None] for n in ("a - b", "c - d")] + [(8, "e - f")], "key long, name string")
    ref = spark.createDataFrame([("a", "b", i) for i in range(5)] + [("c", "d", None), ("g", "h", 9)], "title string, artist string, id long")
    got = sorted(map(repr, map(tuple, catalogue.title_matches(rows, ref, "key", "name").collect())))
    assert got == sorted(repr((k, i)) for k in [*range(7), None] for i in [*range(5), None])
