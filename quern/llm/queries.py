"""The registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import shared_dir, table


def byte_bpe_path() -> str:
    """Default vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe_path(), capacity=1024, end_id=0)


def op2_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op3_histogram_gbdt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gbdt import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


_OP4 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_host_beta_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents")).select(*_OP4)


def op4_host_beta_rules_tables_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents that hold tables as a host of their own, which is a bad one."""
    from .quality_rules import apply_rules

    host = F.when(F.contains("text", F.lit("|")), "tables").otherwise(F.col("source"))
    return apply_rules(table(spark, sf_dir, "documents").withColumn("host", host), host_col="host").select(*_OP4)


def op5_interleaved_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import round_trip

    return round_trip(table(spark, sf_dir, "documents"), byte_bpe_path(), end_id=0)


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the first scans every blob, the second finds none unseen and
    returns what the ledger has."""
    import uuid

    from .secrets import KINDS, scan, spans_text

    docs = table(spark, sf_dir, "documents")
    ledger = f"{shared_dir(spark)}/quern-secret-ledger-{uuid.uuid4().hex}"
    scan(docs, ledger)
    found = scan(docs, ledger)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(spans_text(F.col("spans"), KINDS[:3]), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, KINDS[:3]), base, spans_text(F.col("spans")).alias("spans"))


def op8_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_stupid_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op10_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import label_documents

    return label_documents(table(spark, sf_dir, "documents"))


# --- parts and laws of the results above that SQL can say; the tests hold the rest against brute force

def op1_sum_of_squares_packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and breaches of the packing's laws: ids lost or repeated, sequences too long or with gaps."""
    pieces = op1_sum_of_squares_packing(spark, sf_dir)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("wanted"), F.max(F.col("start") + F.col("length")).alias("upto"))
    docs = whole.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("wanted")) | (F.col("upto") != F.col("wanted"))).alias("documents_broken"))
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("upto"))
    wrong = filled.agg(F.count_if((F.col("n") > 1024) | (F.col("n") != F.col("upto"))).alias("sequences_broken"))
    return docs.join(F.broadcast(wrong))  # one row each


def op2_sampled_splitter_shards_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of all shards, and breaches of the law: shards without gapless slots, or further
    from the mean than two of the largest rows."""
    shards = op2_sampled_splitter_shards(spark, sf_dir).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots")
    )
    whole = shards.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"), F.collect_list(F.struct("n", "bytes", "low", "high", "slots")).alias("s"))  # 40 shards
    gaps = F.size(F.filter("s", lambda x: (x["low"] != 0) | (x["high"] + 1 != x["n"]) | (x["slots"] != x["n"])))
    uneven = F.size(F.filter("s", lambda x: F.abs(x["bytes"] - F.col("bytes") / 40) > 2 * F.col("largest")))
    return whole.select("rows", "bytes", gaps.alias("shards_with_gaps"), uneven.alias("shards_uneven"))


def op5_interleaved_rans_tokens_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and starts that are not the ids of all documents before."""
    rows = op5_interleaved_rans_tokens(spark, sf_dir)
    ends = rows.select((F.col("start") + F.col("n_tokens")).alias("at"), F.lit(1).alias("end"))
    met = rows.select(F.col("start").alias("at"), F.lit(-1).alias("end")).unionByName(ends).groupBy("at").agg(F.sum("end").alias("d"))
    first = rows.agg(F.count(F.lit(1)).alias("documents"), F.min("start").alias("first"))
    return first.join(F.broadcast(met.agg(F.count_if(F.col("d") != 0).alias("loose_ends"))))  # one row each


def op7_blob_ledger_secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_blob_ledger_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op10_diagonal_license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_diagonal_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
