import corpus_pipeline
from quern.llm.secrets import find_spans, without_spans
from test_packing import check_pieces  # noqa: F401  pieces of the last stage obey the same rules


def clean(i):
    return " ".join(f"w{(i * 7919 + j * j) % 5003}x{j % 13}" for j in range(60)) + "."


def test_stages_take_effect(spark, docs, tmp_path):
    passage = " ".join(f"bench{j}" for j in range(20))
    rows = [(i, clean(i)) for i in range(40)] + [(100, clean(3)), (101, "too short"), (102, clean(50) + " " + passage), (103, clean(60) + ' token = "abcdef0123456789abcdef0123456789"')]
    sf = str(tmp_path)
    docs(rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, table, sf)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == table.columns
        out.write.parquet(f"{sf}/{name}")
        table = spark.read.parquet(f"{sf}/{name}")
        seen.append({r["doc_id"] for r in table.select("doc_id").collect()})
        if name == "secret_scan":
            kept = {r["doc_id"]: r for r in table.collect()}
            assert "[secret]" in kept[103]["text"] and not find_spans(kept[103]["text"]) and kept[5]["text"] == clean(5)
            check = [(k, r["text"]) for k, r in kept.items()]
    everyone = set(range(40)) | {100, 101, 102, 103}
    assert seen[0] == everyone - {101}
    assert seen[1] == everyone - {101, 100}
    assert seen[2] == seen[3] == everyone - {101, 100, 102}
    check_pieces(table.collect(), check, 1024)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and len(corpus_pipeline.STAGES) == 5


PASSAGE = " ".join(f"bench{j}" for j in range(20))


def benchmark_folder(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (None, "null id"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_hard_rows_through_every_stage(spark, docs, hard_rows, tmp_path):
    """Null ids and texts, blank and very long texts, repeated rows and ids, clashing columns."""
    sf = benchmark_folder(spark, tmp_path)
    secret = ' token = "abcdef0123456789abcdef0123456789"'
    rows = hard_rows + [
        (50, clean(50)), (50, clean(51)), (50, clean(51)), (None, clean(52)), (None, clean(52)), (None, clean(53) + secret), (51, clean(50)),
        (60, clean(60), None), (61, clean(61) + " " + PASSAGE), (None, clean(62) + " " + PASSAGE), (63, clean(63) + secret),
    ]
    table, left = docs(rows, extra=True), {}
    columns = table.columns
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, table, sf)
        out.write.parquet(f"{sf}/{name}")
        table = spark.read.parquet(f"{sf}/{name}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert table.columns == columns
            left[name] = sorted((r["doc_id"] or 0, r["text"]) for r in table.collect())
            assert all(r["row"] == r["words"] == "other" for r in table.collect())
    long_text = hard_rows[8][1]
    words = [r for r in rows if len((r[1] or "").split()) >= 20]
    repeats = {hard_rows[11][1]}  # one sentence five times
    first = sorted((r[0] or 0, r[1]) for r in words if r[1] not in repeats)
    assert left["quality_rules"] == first
    # One of each group of similar texts stays: that with the smallest id, null ids last.
    second = {(1, hard_rows[0][1]), (6, long_text), (50, clean(50)), (50, clean(51)), (0, clean(52)), (0, clean(53) + secret), (60, clean(60)), (61, clean(61) + " " + PASSAGE), (0, clean(62) + " " + PASSAGE), (63, clean(63) + secret)}
    got = set(left["simhash_near_duplicates"])
    assert second <= got and not [x for x in got - second if jaccard_of_any(x[1], second)]
    third = sorted(x for x in got if PASSAGE not in x[1])
    assert left["winnowing_decontamination"] == third
    assert sorted((i, t.replace("[secret]", "")) for i, t in left["secret_scan"]) == sorted((i, cut(t)) for i, t in third)
    pieces = table.collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 6) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 6)


def cut(text):
    spans = find_spans(text)
    return without_spans(text, [a for _, a, _ in spans], [b for *_, b in spans], "")


def jaccard_of_any(text, others):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    return [1 for _, t in others if len(grams(t) & grams(text)) >= 0.8 * len(grams(t) | grams(text))]


def test_empty_table_through_every_stage(spark, docs, tmp_path):
    sf = benchmark_folder(spark, tmp_path)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs([]), sf).count() == 0, name
