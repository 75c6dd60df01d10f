"""Table reads and worker set-up of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, importable, shared_dir, stage

__all__ = ["columns_or_null", "discard", "frequent", "join_spread", "prepare", "read_bytes", "shared_dir", "shuffle_partitions", "stage", "table"]

#: Rows, and bytes about, of one Arrow batch that goes to Python; they bound a worker's memory with long texts.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
#: What the optimizer says of plans whose size it does not know is beyond this.
_UNKNOWN_BYTES = 1 << 50


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep their batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return importable(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession, rows: int = 0, rows_each: int = 1_000_000) -> int:
    """The session's shuffle partitions, or more where ``rows`` ask for them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_each))


def read_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of ``df``: those of its files where the optimizer knows them (nothing is read then),
    else those of its texts."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < _UNKNOWN_BYTES:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("binary"))), F.lit(0))).first()[0]


def columns_or_null(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """Exactly the wanted columns, each as ``new_name=(column, type)``; other columns go,
    so names that clash with an operator's own do no harm."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(n) for n, (c, t) in wanted.items()])


#: Keys with more than one in so many of all rows are frequent; there are fewer of them than that.
FREQUENT_ONE_IN = 1_000
SALTS = 64


def frequent(counted: DataFrame, key: str, count: str = "rows") -> DataFrame:
    """Frequent keys of a table ``(key, count)`` that has each key once: at most FREQUENT_ONE_IN."""
    total = counted.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return counted.where(F.col(count) * FREQUENT_ONE_IN > total).select(key)


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table``, which has each key once, on ``key``.

    Rows of the ``hot`` keys (see ``frequent``; few, so they are broadcast) are dealt to SALTS
    tasks each, to which the table's rows of these keys go in as many copies.
    """
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    own = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(hot, key, "left").withColumn("_salt", own).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
