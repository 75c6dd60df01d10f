"""Secret scan through an incremental blob ledger.

A version of a document is a blob, named by the SHA-256 of its text. The ledger holds, for
each blob and rule version that was ever scanned, the spans found; a run scans only pairs
that the ledger lacks and joins the ledger's findings back to every path (document) that
holds the blob. Texts are scanned where they are read and never shuffled: a task scans a
blob once however often it meets it, and only names and spans are brought together, one
row for each blob. Where the ledger knows blobs already, those it lacks are told to the
scan: broadcast while they are few, else by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ._store import columns_or_null, frequent, join_spread, prepare, stage

RULE_VERSION = "3"
#: Up to so many unseen blobs are broadcast where the ledger knows others.
BROADCAST_BLOBS = 100_000
#: Blobs that a task remembers as scanned.
TASK_BLOBS = 1_000_000
#: Base kinds in the contract's order, then this module's own (fixed order for output).
KINDS = ("assign", "access", "hex", "pem", "jwt", "github", "slack", "url")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OWN = {
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
}
_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_URL_SCHEME = re.compile(r"\b[a-z][a-z0-9+.-]+\Z")
_URL_LOGIN = re.compile(r"[^\s:/@]+:[^\s/@]{3,}@")
_SCHEME_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6


def _pem_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Every key block of any length: from a BEGIN mark to the next END mark."""
    begin = _PEM_BEGIN.search(text)
    while begin and (end := _PEM_END.search(text, begin.end())):
        yield "pem", begin.start(), end.end()
        begin = _PEM_BEGIN.search(text, end.end())


def _url_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """URLs with a user and a password of any length, up to the at sign."""
    done, at = 0, text.find("://")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _SCHEME_LETTERS:
            begin -= 1
        scheme = _URL_SCHEME.search(text[max(begin - 1, 0) : at])
        login = _URL_LOGIN.match(text, at + 3) if scheme else None
        if login:
            yield "url", max(begin - 1, 0) + scheme.start(), login.end()
        done = login.end() if login else at + 3
        at = text.find("://", done)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind as listed; ends are exclusive.

    Time is in proportion to the text's length; no kind has a longest match.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, (mark, pattern) in _OWN.items():
        if mark in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "-----BEGIN" in text:
        found += _pem_spans(text)
    if "://" in text:
        found += _url_spans(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<kind:string,start:int,end:int>>"


def _scan_task(batches: Iterable[pa.RecordBatch], version: str) -> Iterator[pa.RecordBatch]:
    names, seen = ("kind", "start", "end"), set()
    for b in batches:
        blobs, spans = [], []
        for blob, text in zip(b.column("blob").to_pylist(), b.column("text").to_pylist()):
            if blob not in seen:
                if len(seen) >= TASK_BLOBS:
                    seen.clear()
                seen.add(blob)
                blobs.append(blob)
                spans.append([dict(zip(names, s)) for s in find_spans(text)])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array([version] * len(spans), pa.string()), pa.array(spans, _SPANS)], names=["blob", "rule_version", "spans"])


def _blobs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("blob", F.sha2("text", 256))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, blob)`` of every row; a null text counts as empty."""
    return _blobs(docs, id_col, text_col).select("doc_id", "blob")


def scan_unseen(docs: DataFrame, blobs: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text", broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """New ledger rows ``(blob, rule_version, spans)``, one for each of ``blobs`` that the ledger
    lacks under this version."""
    texts = _blobs(docs, id_col, text_col).select("blob", "text")
    known = None if ledger is None else ledger.where(F.col("rule_version") == rule_version).select("blob")
    if known is not None and not known.isEmpty():
        unseen = stage(blobs.select("blob").join(known, "blob", "left_anti"), "unseen-blobs")
        few = unseen.limit(broadcast_blobs + 1).count()
        if not few:
            return docs.sparkSession.createDataFrame([], LEDGER_SCHEMA)
        texts = texts.join(F.broadcast(unseen) if few <= broadcast_blobs else unseen, "blob", "left_semi")
    scanned = texts.mapInArrow(lambda batches: _scan_task(batches, rule_version), LEDGER_SCHEMA)
    # Copies that several tasks met give equal rows.
    return scanned.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def scan(docs: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, blob, spans)`` of every row.

    With ``ledger_path`` the ledger there is read if it exists and the new rows are
    appended; without, a ledger of this run alone is used. A null text is an empty blob; a
    null id stays null; repeated rows are returned once each; an empty table gives no rows;
    other columns are not looked at.
    """
    spark = prepare(docs.sparkSession)
    paths = stage(versions(docs, id_col, text_col), "blob-paths")
    blobs = stage(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("rows")), "blobs")
    known = None
    if ledger_path:
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)
        known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    new = stage(scan_unseen(docs, blobs, known, rule_version, id_col, text_col), "ledger")
    if ledger_path:
        new.write.mode("append").parquet(ledger_path)
        new = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).where(F.col("rule_version") == rule_version)
    found = new.where(F.size("spans") > 0).select("blob", "spans")
    joined = join_spread(paths, found, "blob", frequent(blobs, "blob"))
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


def spans_text(spans, kinds=None):
    """``kind:start:end`` of the spans, comma-joined, as a column."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without_spans(text: str, starts: Iterable[int], ends: Iterable[int], mark: str) -> str:
    """``text`` with each span, or run of overlapping spans by start, replaced by ``mark``."""
    out, at = [], 0
    for start, end in zip(starts, ends):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span found replaced by ``mark``; ``n_chars`` follows the text.

    Overlapping spans are replaced as one. Rows without a finding, null and empty texts among
    them, are passed as they are; null and repeated ids are told apart by their texts, so rows
    that repeat an id get their own findings; an empty table gives no rows; other columns are
    passed on, whatever their names.
    """
    found = scan(docs).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_quern_id"), F.col("blob").alias("_quern_blob"), F.col("spans").alias("_quern_spans")).dropDuplicates(["_quern_id", "_quern_blob"])
    found = stage(found, "redactions").hint("shuffle_hash")
    text, spans = F.col("text"), F.col("_quern_spans")
    # By id and blob: copies of one text do not meet in one task.
    both = docs.join(found, docs["doc_id"].eqNullSafe(found["_quern_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == found["_quern_blob"]), "left")

    @pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_spans(t, a, b, mark) for t, a, b in zip(text, starts, ends)], dtype=object)

    # Texts without a finding do not go to Python.
    changed = cut(F.when(spans.isNotNull(), text), F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))
    both = both.withColumn("_quern_text", changed)
    new = {
        "text": F.when(spans.isNull(), text).otherwise(F.col("_quern_text")).alias("text"),
        "n_chars": F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length("_quern_text").cast("long")).alias("n_chars"),
    }
    return both.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])
