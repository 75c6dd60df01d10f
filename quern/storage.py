"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}" if paths else root
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, as in local tests, a folder of its own."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    given = given or spark.conf.get("quern.shared.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", given)
    return given.rstrip("/")


def stage(df: DataFrame, name: str, by: Sequence[str] = (), **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders ``by`` columns, with the writer's options, and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=list(by) or None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read again: all that was made of them is staged itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
