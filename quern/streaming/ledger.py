"""Ledgers as streams: latest entries, pending work, idempotent appends, a breaker.

Resume is the query's checkpoint: offsets and state are committed with each batch, so a
restarted query neither repeats nor skips a record.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_each: int = 100) -> DataFrame:
    """A stream of records; ``files_each`` limits a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(fmt).load(path)


def latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key by ``order``: one row of state for each key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def pending(stream: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records whose key is not done yet: a stream-static anti join."""
    return stream.join(done.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_outer").where("_done is null").drop("_done")


def windowed_rates(stream: DataFrame, time: str, group: str, hit: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits and rows of each group and time window; rows later than the watermark are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group)
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("k")).select(F.col("w.start").alias("start"), group, "n", "k")


def append_idempotent(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append batches so that a repeated batch replaces itself: one folder for each batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


BREAKER = "key string, seen long, failures long, open boolean"


def breaker(stream: DataFrame, key: str, failed: str, order: str, most: int = 5) -> DataFrame:
    """State for each key: rows seen, failures in a row, and whether ``most`` of them came
    in a row at any time (then it stays open)."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(failed).alias("failed"), F.col(order).alias("at"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, run, is_open = state.get if state.exists else (0, 0, False)
        for failed_now in pd.concat(list(batches)).sort_values("at")["failed"]:
            seen, run = seen + 1, run + 1 if failed_now else 0
            is_open = is_open or run >= most
        state.update((seen, run, is_open))
        yield pd.DataFrame({"key": [k[0]], "seen": [seen], "failures": [run], "open": [is_open]})

    return rows.groupBy("key").applyInPandasWithState(step, BREAKER, "seen long, failures long, open boolean", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows, or of an updated result the last row
    of each key (its first column). Rows go to a folder for each batch, not to the driver."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(path)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("_last"))), F.col("batch") == F.col("_last")).drop("batch", "_last")  # one row
    key, *rest = stream.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


class Progress(StreamingQueryListener):
    """Notes batches and rows of every running query; ``report`` is called at most once in ``seconds``."""

    def __init__(self, report=print, seconds: float = 60.0):
        self.report, self.seconds, self.rows, self.batches, self._last = report, seconds, 0, 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        if time.monotonic() - self._last >= self.seconds:
            self._last = time.monotonic()
            self.report(f"{self.batches} batches, {self.rows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(f"{self.batches} batches, {self.rows} rows")
