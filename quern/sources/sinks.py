"""Sinks: write-once tables, metric files, per-model artifacts."""

from __future__ import annotations

import hashlib
import io
import json
import stat
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import set_digest


class Differs(ValueError):
    """A write-once target exists and holds something else."""


def content_digest(df: DataFrame) -> str:
    """An order-free digest of a table's rows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(set_digest(row)).first()[0]


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless ``path`` holds it already: equal rows are no work (False), other
    rows an error."""
    try:
        old = df.sparkSession.read.parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return True
    if sorted(old.columns) != sorted(df.columns) or content_digest(old) != content_digest(df):
        raise Differs(path)
    return False


def write_metrics_csv(long: DataFrame, path: str) -> None:
    """Long-form metrics as CSV in a steady order of columns."""
    wanted = ["model", "scope", "cohort", "metric", "estimate", "lower", "upper", "finite_replicates", "replicates"]
    rows = long.select(*[F.col(c) if c in long.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_by_model(df: DataFrame, path: str, model: str = "model") -> None:
    """A folder for each model."""
    df.repartition(model).write.mode("overwrite").partitionBy(model).parquet(path)


def write_text(lines: DataFrame, path: str, order: str) -> None:
    """One text file, lines in order; Spark's commit makes it appear whole or not at all."""
    lines.coalesce(1).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def describe_ids(ids: DataFrame, path: str, column: str = "track_id") -> DataFrame:
    """``(path, n, digest)`` of a cohort."""
    ordered = F.array_sort(F.collect_list(F.col(column).cast("string")))
    return ids.agg(F.lit(path).alias("path"), F.count(column).alias("n"), F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


#: Time stamp of every member of a deterministic archive.
ZIP_TIME = (1980, 1, 1, 0, 0, 0)
MOST_ARCHIVE_BYTES = 256 << 20


def zip_bytes(members: dict[str, bytes]) -> bytes:
    """An archive whose bytes depend on its members' names and contents alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, ZIP_TIME)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            archive.writestr(info, members[name], compresslevel=9)
    return out.getvalue()


def unzip_bytes(data: bytes, most: int = MOST_ARCHIVE_BYTES) -> dict[str, bytes]:
    """Members of an archive: plain files with safe, distinct names and ``most`` bytes at most."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        found = archive.infolist()
        names = [i.filename for i in found]
        if len(set(names)) != len(names) or sum(i.file_size for i in found) > most:
            raise ValueError("repeated names, or more bytes than allowed")
        for i in found:
            parts = i.filename.split("/")
            if i.is_dir() or "\\" in i.filename or any(p in ("", ".", "..") for p in parts) or stat.S_IFMT(i.external_attr >> 16) not in (0, stat.S_IFREG):
                raise ValueError(f"unsafe member: {i.filename}")
        return {i.filename: archive.read(i) for i in found}


def bundled(files: DataFrame, bundle: str = "bundle", name: str = "file", content: str = "content") -> DataFrame:
    """``(bundle, archive, sha256)``: one deterministic archive for each bundle of files, with a list
    of their digests as ``MANIFEST.json``. A bundle is a few files that one task holds."""
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        members = {n: bytes(c) for n, c in zip(rows[name], rows[content])}
        listed = {n: hashlib.sha256(c).hexdigest() for n, c in members.items()}
        data = zip_bytes({**members, "MANIFEST.json": json.dumps(listed, sort_keys=True, indent=1).encode()})
        return pd.DataFrame({bundle: [key[0]], "archive": [data], "sha256": [hashlib.sha256(data).hexdigest()]})

    kind = files.schema[bundle].dataType.simpleString()
    return files.select(bundle, name, F.col(content).cast("binary").alias(content)).groupBy(bundle).applyInPandas(pack, f"{bundle} {kind}, archive binary, sha256 string")


def extracted(archives: DataFrame, bundle: str = "bundle") -> DataFrame:
    """``(bundle, file, content)`` of archives; an unsafe one, or one whose list of digests does not
    hold, is an error."""
    def unpack(batches):
        for batch in batches:
            for key, data in zip(batch[bundle], batch["archive"]):
                members = unzip_bytes(bytes(data))
                listed = json.loads(members.pop("MANIFEST.json"))
                if listed != {n: hashlib.sha256(c).hexdigest() for n, c in members.items()}:
                    raise ValueError(f"the list of digests of {key} does not hold")
                yield pd.DataFrame({bundle: [key] * len(members), "file": list(members), "content": list(members.values())})

    kind = archives.schema[bundle].dataType.simpleString()
    return archives.select(bundle, "archive").mapInPandas(unpack, f"{bundle} {kind}, file string, content binary")
