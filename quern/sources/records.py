"""Line records, ledgers, directory listings and archive members."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.texts import leading_number

MEMBERS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("data_offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()),
])


def read_index(spark: SparkSession, path: str, schema: T.StructType = MEMBERS) -> DataFrame:
    """Records of a folder of JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, key: str = "path") -> DataFrame:
    """The last whole entry of each key of an append-only ledger; torn lines are skipped.

    Lines are ordered by file, block and place, which a scan keeps inside each task.
    """
    full = T.StructType([*schema.fields, T.StructField("_torn", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = rows.select("*", place.alias("_at")).where(F.col("_torn").isNull() & F.col(key).isNotNull())
    rest = [f.name for f in schema.fields if f.name != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(key, "r.*")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, name, stem, size)`` of a folder tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TarReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Shard]:
        return [_Shard(p) for p in self.paths]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        shard = partition.path.rsplit("/", 1)[-1]
        with tarfile.open(partition.path, "r:", errorlevel=0) as tar:
            for m in tar:
                kind = "file" if m.isfile() else "dir" if m.isdir() else "other"
                yield m.name, kind, shard, m.offset, m.offset_data, m.size, int(m.mtime)


class TarMembers(DataSource):
    """Members of tar shards without their contents: ``spark.read.format("tar_members")``
    with ``paths`` comma-joined; one partition for each shard, only headers are read."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> T.StructType:
        return MEMBERS

    def reader(self, schema: T.StructType) -> _TarReader:
        return _TarReader([p for p in self.options["paths"].split(",") if p])


def read_tar_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("paths", ",".join(paths)).load()


def files_by_id(files: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """``(id, path)`` of listed files whose name starts with a number; the first path of an id wins,
    and with ``folders`` only files that lie directly in one of them count."""
    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.withColumn("id", leading_number("name")).where("id is not null")
    return (rows.where(folder.isin(*folders)) if folders is not None else rows).groupBy("id").agg(F.min("path").alias("path"))


def sizes_by_stem(files: DataFrame) -> DataFrame:
    return files.groupBy("stem").agg(F.max("size").alias("size"))


def write_index(members: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder of JSON lines for each shard; Spark's ``_SUCCESS`` tells a whole one, and writing
    a shard again replaces it."""
    members.repartition(shard).write.mode("overwrite").partitionBy(shard).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of JSON lines; a batch appears whole or not at all."""
    rows.write.mode("append").json(path)
