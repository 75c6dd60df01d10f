"""Benchmark decontamination by winnowing.

An item's window is 13 consecutive words, or the whole item if it has fewer. For windows
of L words the fingerprints are the minima of the k-gram hashes in every run of L words
(k is half of L, rounded up), so two texts that share a window share its fingerprint:
none is missed. Documents' fingerprints are joined to the benchmark's; only documents
with a match are looked at again, only windows whose minimum matched are spelt out, and
these are joined to the benchmark's windows word for word. Hit words are the union of
the windows found. Long shared passages cost a row for each window, never for each pair
of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import covered, gram_hashes, let, plain_words, word_hashes
from ._store import prepare, stage

WINDOW_WORDS = 13
#: A document is contaminated from this share of hit words: one in so many.
CONTAMINATED_ONE_IN = 20
#: Up to so many fingerprints or matched documents are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 16


def minima(hashes: Column, length: int) -> Column:
    """Least k-gram hash in every run of ``length`` words, in order of the run's start."""
    k = (length + 1) // 2
    width = length - k + 1

    def wider(x: Column, step: int) -> Column:
        later = F.slice(x, F.lit(step + 1), F.greatest(F.size(x) - step, F.lit(0)))
        return F.zip_with(x, later, lambda a, b: F.least(a, b))

    def widen(column: Column, step: int) -> Column:
        return let(column, lambda x: wider(x, step))

    def runs(g: Column) -> Column:
        # Minima over 1, 2, 4 ... grams, each from two of the size before.
        out, done = g, 1
        while done < width:
            step = min(done, width - done)
            out = widen(out, step)
            done += step
        return F.slice(out, F.lit(1), F.greatest(F.size(g) - (width - 1), F.lit(0)))

    return let(gram_hashes(hashes, k, tag=length), runs)


def _item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``(length, words, items, fp)``: each distinct window once."""
    words = plain_words(F.col(f"`{text_col}`").cast("string"))

    def spell(w: Column, length: int) -> Column:
        def at(i: Column) -> Column:
            return F.struct(F.lit(length).alias("length"), F.array_join(F.slice(w, i, length), " ").alias("words"), F.get(F.col("_m"), i - 1).alias("fp"))

        return at

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    out = None
    for length in range(1, window + 1):
        fit = F.size("w") == length if length < window else F.size("w") >= window
        part = rows.where(fit).withColumn("_m", minima(word_hashes(F.col("w")), length))
        body = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), spell(F.col("w"), length))
        part = part.select("item_id", F.explode(body).alias("x")).select("item_id", "x.*")
        out = part if out is None else out.union(part)
    return out.groupBy("length", "words").agg(F.collect_set("item_id").alias("items"), F.min("fp").alias("fp"))


def _flat(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


def _few(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; looks at no more than that."""
    return df.limit(limit + 1).count() <= limit


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, text_hash, n_hit, items)`` of the documents with a hit; items are sorted
    as strings."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = stage(_item_windows(benchmark, window, item_col, item_text_col), "benchmark-windows")
    lengths = sorted(r[0] for r in found.select("length").distinct().collect())  # at most `window` of them
    empty = "doc_id long, text_hash long, n_hit long, items array<string>"
    if not lengths:
        return docs.sparkSession.createDataFrame([], empty)

    prints = found.select("fp").distinct()
    mins = let(word_hashes(plain_words(F.col("text"))), lambda h: F.array_distinct(_flat([minima(h, n) for n in lengths])))
    dealt = rows.select("doc_id", "text_hash", F.explode_outer(mins).alias("fp")).where(F.col("fp").isNotNull())
    if _few(prints, broadcast_rows):
        met = dealt.join(F.broadcast(prints), "fp", "left_semi")
    else:
        salted = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["fp", "salt"], "left_semi")
    met = stage(met.groupBy("doc_id", "text_hash").agg(F.collect_set("fp").alias("met")), "matched-documents")

    matched = met.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "met")
    if _few(met, broadcast_rows) and (met.agg(F.sum(F.size("met"))).first()[0] or 0) <= 16 * broadcast_rows:
        matched = F.broadcast(matched)
    again = rows.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t")))

    def spelt(w: Column) -> Column:
        def one(length: int) -> Column:
            def pick(m: Column) -> Column:
                at = F.filter(F.transform(m, lambda x, i: F.when(F.array_contains(F.col("met"), x), i)), lambda i: i.isNotNull())
                return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(w, i + 1, length), " ").alias("words")))

            return let(minima(word_hashes(w), length), pick)

        return _flat([one(n) for n in lengths])

    spans = again.select("doc_id", "text_hash", F.explode_outer(let(plain_words(F.col("text")), spelt)).alias("x"))
    spans = spans.select("doc_id", "text_hash", "x.*").where(F.col("start").isNotNull())
    windows = found.select("length", "words", "items")
    windows = F.broadcast(windows) if _few(windows, broadcast_rows // 4) else windows
    spans = spans.join(windows, ["length", "words"]).distinct()
    by_doc = spans.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("length").cast("long").alias("length")))).alias("s"),
        F.flatten(F.collect_set("items")).alias("items"),
    )
    items = F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))
    return by_doc.select("doc_id", "text_hash", covered(F.col("s")).alias("n_hit"), items.alias("items"))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, one_in: int = CONTAMINATED_ONE_IN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, text_hash, n_words, n_hit, items, contaminated)`` of every row.

    A null text has no words. Items with a null or wordless text match nothing; an item
    with a null id marks words but is not listed. A null document id stays null; repeated
    rows are returned once each, with equal results; without items or documents nothing
    is contaminated.
    """
    found = hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col, broadcast_rows)
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_hit", "items")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
        F.size(plain_words(F.col(f"`{text_col}`").cast("string"))).cast("long").alias("n_words"),
    )
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the contaminated rows."""
    gone = judge(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    gone = stage(gone, "contaminated").hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["t"]), "left_anti")
