from quern.llm import queries

CONTRACT = {
    "op1": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op2": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op3": {"doc_id", "held_out", "score", "predicted"},
    "op4": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op6": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8": {"doc_id", "fingerprint", "component_id"},
    "op9": {"doc_id", "score"},
    "op10": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
}


def test_every_query_runs_with_its_columns(spark, sf):
    found = queries.queries()
    assert {n.split("_")[0] for n in found} == set(CONTRACT)
    ids = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()
    for name, f in found.items():
        if name.endswith(("_laws", "_base")):
            continue  # parts of the others
        df = f(spark, sf)
        assert CONTRACT[name.split("_")[0]] <= set(df.columns), name
        assert df.select("doc_id").distinct().count() == ids, name
    assert set(queries.oracle_sql()) <= set(found)
