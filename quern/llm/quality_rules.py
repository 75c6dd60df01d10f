"""Quality rules with host-level verdicts.

Each document is measured in its own row, without a shuffle; the measures are written
once. Rule failures are then added up by host (a partial sum, so a host with a third of
all rows is no hot spot), each host's failure rate is shrunk towards a beta prior fitted
to all hosts by moments, a host is bad if its rate stands in the prior's upper tail or over
a half, and the verdicts are joined back: broadcast while there are few hosts, else by a
join on the host and a salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import SPACE_RUN, covered, gram_hashes, let, space_words, word_hashes
from ._store import prepare, stage

#: Characters that count as symbols (fixed value of the contract).
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A soft rule fails beyond these: symbols and repeated lines in percent, mean word length.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTHS = (2, 15)
#: A host is bad beyond this shrunken failure rate, or beyond so many standard deviations of
#: the prior over its mean, whichever is less.
BAD_HOST_RATE = 0.5
BAD_HOST_SPREAD = 2.0
BROADCAST_HOSTS = 100_000
SALTS = 32


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window that the text holds twice or more, the first included."""
    zero = F.lit(0).cast("long")

    def repeated(runs: Column) -> Column:
        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("start"))))

        def twins(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)
                return before | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            spans = F.transform(F.filter(s, twin), lambda x: F.struct(x["start"].alias("start"), F.lit(REPEAT_WINDOW).cast("long").alias("length")))
            return covered(F.array_sort(spans))

        return let(pairs, twins)

    runs = gram_hashes(word_hashes(words), REPEAT_WINDOW)
    return let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), zero).otherwise(repeated(r)))


def _measures(text: Column) -> Column:
    def body(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    return let(space_words(text), body)


def _lines(text: Column) -> Column:
    def body(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return let(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE_RUN, "") != ""), body)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and rule failures of every row; ``text_hash`` tells rows of one id apart."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), _measures(text).alias("w"), _lines(text).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n, chars = F.col("w.n_words"), F.col("w.word_chars")
    soft = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * chars)
        | (100 * F.col("l.n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("l.n_lines"))
        | (chars < WORD_LENGTHS[0] * n) | (chars > WORD_LENGTHS[1] * n)
    )
    return rows.select(
        "doc_id", "host", "text_hash", n.alias("n_words"), chars.alias("word_chars"), "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        soft.alias("soft_failed"),
    )


def host_verdicts(measured: DataFrame, bad_rate: float = BAD_HOST_RATE, spread: float = BAD_HOST_SPREAD) -> DataFrame:
    """``(host, n, failed, rate, bad)``: failure rates shrunk to a beta prior of all hosts.

    The prior's mean is the mean host rate and its weight follows from the variance
    between hosts beyond what chance gives; it is held between 1 and 10,000 documents. Where
    hosts differ by chance alone the prior is narrow, rates are shrunk onto it, and no host is bad.
    """
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed"))
    hosts = stage(hosts, "hosts")
    p = F.col("failed") / F.col("n")
    m = hosts.agg(F.avg(p).alias("mean"), F.var_samp(p).alias("var"), F.avg(p * (1 - p) / F.col("n")).alias("noise")).first()
    mean, between = m["mean"] or 0.0, (m["var"] or 0.0) - (m["noise"] or 0.0)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    bound = min(bad_rate, mean + spread * math.sqrt(mean * (1 - mean) / (weight + 1)))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > bound).alias("bad"))


def _with_verdicts(measured: DataFrame, hosts: DataFrame, broadcast_hosts: int) -> DataFrame:
    verdict = hosts.select(F.col("host").alias("h"), "bad")
    if hosts.count() <= broadcast_hosts:
        verdict = F.broadcast(verdict)
        return measured.join(verdict, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    salted = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = measured.withColumn("s", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.col("s") == F.col("salt")), "left").drop("h", "salt", "s")


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", bad_rate: float = BAD_HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row.

    A row that fails a base rule is not kept. Any other is kept unless its host is bad and
    it fails a soft rule (symbols, repeated lines, word lengths), so a clean document of a
    bad host stays. A null text has no words and fails; rows with a null host form one
    host; a null id stays null; repeated rows are returned once each; an empty table gives
    no rows.
    """
    measured = stage(measure(docs, id_col, text_col, host_col), "rule-measures")
    judged = _with_verdicts(measured, host_verdicts(measured, bad_rate), broadcast_hosts)
    return judged.withColumn("kept", ~F.col("base_failed") & ~(F.coalesce("bad", F.lit(False)) & F.col("soft_failed")))


def keep_passed(docs: DataFrame) -> DataFrame:
    """``docs`` less the rows that the rules reject, told apart by id and text.

    Null and wordless texts are rejected; null ids and hosts, repeated rows and clashing
    column names are as in ``apply_rules``; an empty table gives no rows.
    """
    gone = apply_rules(docs).where(~F.col("kept")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    gone = stage(gone, "rejected").hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["t"]), "left_anti")
