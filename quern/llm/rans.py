"""Token files under a static range asymmetric numeral system.

Documents are put in order of their ids by a range partition; every task encodes its run
of documents into segments of a few million ids. A segment is one file: a frequency table
shared by all its blocks, an index of its documents, and blocks that decode on their own.
In a block many lanes, each with a 64-bit state, take turns and share one stream of 32-bit
words, so numpy advances all lanes at once. At steady distances a block notes its states
and its place in the stream: decoding can start at any of these checkpoints. The header
and the ids of each run between checkpoints carry checksums.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import columns_or_null, prepare, read_bytes, shared_dir, shuffle_partitions
from ._tokens import ID_BYTES, encoder, pack_ids

MAGIC = b"QRNS"
VERSION = 1
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
WORD_MASK = np.uint64((1 << 32) - 1)
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 128
SEGMENT_TOKENS = 1 << 22
#: Bytes of input, as stored, for each range of ids; a range is a task and some segments.
RANGE_BYTES = 64 << 20
#: magic, version, scale bits, documents, ids, symbols, blocks.
_HEAD = struct.Struct("<4sHHQQII")
#: ids, lanes, words, checkpoints.
_BLOCK = struct.Struct("<IIII")


def frequencies(ids: np.ndarray, bits: int = SCALE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in use and their frequencies, which sum to ``2**bits`` and are all positive."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, total = counts[symbols], 1 << bits
    if len(symbols) > total:
        raise ValueError("more symbols than the scale has places")
    f = np.maximum(1, counts.astype(np.int64) * total // max(counts.sum(), 1))
    order = np.argsort(-f, kind="stable")
    excess = int(f.sum()) - total
    if excess < 0 and len(f):
        f[order[0]] -= excess
    for i in order:
        if excess <= 0:
            break
        take = min(excess, int(f[i]) - 1)
        f[i] -= take
        excess -= take
    return symbols.astype(np.uint32), f.astype(np.uint32)


def encode_block(at: np.ndarray, f: np.ndarray, cum: np.ndarray, lanes: int, bits: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Words, and checkpoints ``(step, word, states)``, of symbol places ``at``."""
    steps = -(-len(at) // lanes)
    state = np.full(lanes, LOW, dtype=np.uint64)
    words, marks, sizes = [None] * steps, [], np.zeros(steps + 1, dtype=np.int64)
    shift, scale = np.uint64(63 - bits), np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = at[t * lanes : (t + 1) * lanes]
        x, freq = state[: len(s)], f[s]
        full = x >= (freq << shift)
        words[t] = (x[full] & WORD_MASK).astype(np.uint32)
        x = np.where(full, x >> WORD, x)
        q = x // freq
        state[: len(s)] = (q << scale) + (x - q * freq) + cum[s]
        sizes[t] = len(words[t])
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, state.copy()))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])])
    return np.concatenate(words), [(t, int(starts[t]), x) for t, x in reversed(marks)]


def decode_run(words: np.ndarray, state: np.ndarray, n: int, slots: np.ndarray, f: np.ndarray, cum: np.ndarray, bits: int) -> np.ndarray:
    """Symbol places of ``n`` ids from a checkpoint's states and the words behind it."""
    lanes, out, at = len(state), np.empty(n, dtype=np.int64), 0
    mask, scale, state = np.uint64((1 << bits) - 1), np.uint64(bits), state.copy()
    for start in range(0, n, lanes):
        x = state[: min(lanes, n - start)]
        low = x & mask
        s = slots[low]
        out[start : start + len(x)] = s
        x = f[s] * (x >> scale) + low - cum[s]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << WORD) | words[at : at + len(need)]
        at += len(need)
        state[: len(x)] = x
    return out


def encode_segment(doc_ids: list, lengths: list[int], packed: bytes, bits: int = SCALE_BITS) -> bytes:
    """One file: header, table, document index and blocks."""
    ids = np.frombuffer(packed, dtype="<u4")
    symbols, f = frequencies(ids, bits)
    wide, cum = f.astype(np.uint64), np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64) if len(f) else np.empty(0, np.uint64)
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 0, dtype=np.int32)
    place[symbols] = np.arange(len(symbols))
    places = place[ids]
    n_blocks = -(-len(ids) // BLOCK_TOKENS)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = b"".join([
        _HEAD.pack(MAGIC, VERSION, bits, len(doc_ids), len(ids), len(symbols), n_blocks),
        symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), nulls.tobytes(), np.array(lengths, dtype="<u8").tobytes(),
    ])
    parts = [head, struct.pack("<I", zlib.crc32(head))]
    for b in range(n_blocks):
        at = places[b * BLOCK_TOKENS : (b + 1) * BLOCK_TOKENS]
        lanes = min(LANES, -(-len(at) // 64))
        words, marks = encode_block(at, wide, cum, lanes, bits)
        parts.append(_BLOCK.pack(len(at), lanes, len(words), len(marks)))
        for t, word, states in marks:
            lo = b * BLOCK_TOKENS + t * lanes
            run = ids[lo : min(lo + CHECKPOINT_STEPS * lanes, b * BLOCK_TOKENS + len(at))]
            parts.append(struct.pack("<III", t, word, zlib.crc32(run.tobytes())) + states.astype("<u8").tobytes())
        parts.append(words.astype("<u4").tobytes())
    return b"".join(parts)


class Segment:
    """A file's tables and checkpoints; ``decode(i)`` decodes the i-th run on its own."""

    def __init__(self, data: bytes):
        magic, version, self.bits, docs, self.n, symbols, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.symbols, f = take("<u4", symbols), take("<u4", symbols)
        ids, nulls = take("<i8", docs), take("<u1", docs)
        self.lengths = take("<u8", docs).astype(np.int64)
        head = at
        if int(take("<u4", 1)[0]) != zlib.crc32(data[:head]):
            raise ValueError("the header's checksum differs")
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, nulls)]
        self.f = f.astype(np.uint64)
        self.cum = (np.cumsum(self.f) - self.f).astype(np.uint64)
        self.slots = np.repeat(np.arange(symbols), f.astype(np.int64))
        self.runs = []
        for _ in range(blocks):
            n, lanes, words, marks = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            noted = []
            for _ in range(marks):
                step, word, crc = take("<u4", 3)
                noted.append((int(step), int(word), int(crc), take("<u8", lanes)))
            stream = take("<u4", words)
            for i, (step, word, crc, states) in enumerate(noted):
                end = noted[i + 1][1] if i + 1 < marks else words
                size = min(n - step * lanes, CHECKPOINT_STEPS * lanes)
                self.runs.append((size, crc, states, stream[word:end]))

    def decode(self, i: int) -> np.ndarray:
        n, crc, states, words = self.runs[i]
        ids = self.symbols[decode_run(words.astype(np.uint64), states, n, self.slots, self.f, self.cum, self.bits)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"the checksum of run {i} differs")
        return ids

    def ids(self) -> np.ndarray:
        runs = [self.decode(i) for i in range(len(self.runs))]
        return np.concatenate(runs) if runs else np.empty(0, dtype="<u4")


FILE_SCHEMA = "part int, segment int, docs long, tokens long, payload binary"


def _encode_task(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    enc, end, part, segment = encoder(tokenizer), pack_ids([end_id]), TaskContext.get().partitionId(), 0
    ids, lengths, held, size = [], [], [], 0
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("payload", pa.binary())])

    def file() -> pa.RecordBatch:
        row = [[part], [segment], [len(ids)], [size], [encode_segment(ids, lengths, b"".join(held))]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    for b in batches:
        for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            packed = enc.encode(text) + end
            ids.append(key)
            lengths.append(len(packed) // ID_BYTES)
            held.append(packed)
            size += lengths[-1]
            if size >= segment_tokens:
                yield file()
                segment += 1
                ids, lengths, held, size = [], [], [], 0
    if ids:
        yield file()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write token files under ``path``, in ascending order of id (null ids first, rows of
    one id by their text's hash). They travel as rows ``(part, segment, payload)`` of a
    Parquet table, so any store that Spark writes to will do."""
    spark = prepare(docs.sparkSession)
    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("h", F.xxhash64("text"))
    parts = shuffle_partitions(spark, read_bytes(docs, text_col), RANGE_BYTES)
    rows = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = rows.select("doc_id", "text").mapInArrow(lambda b: _encode_task(b, tokenizer, end_id, segment_tokens), FILE_SCHEMA)
    files.write.option("compression", "uncompressed").parquet(path)


def _decode_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, number, payload in zip(b.column("part").to_pylist(), b.column("segment").to_pylist(), b.column("payload").to_pylist()):
            segment = Segment(payload)
            data, ends = segment.ids().tobytes(), np.cumsum(segment.lengths)
            starts = ends - segment.lengths
            crc = [zlib.crc32(memoryview(data)[s * ID_BYTES : e * ID_BYTES]) for s, e in zip(starts.tolist(), ends.tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(starts), pa.array(segment.lengths), pa.array(crc, pa.int64())],
                names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_token_index(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""
    prepare(spark)
    # A payload is a few MB, and a batch of ARROW_BYTES holds a few of them.
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # Ids before each part: one number for each partition that was written.
    before, base = [], 0
    for part, tokens in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("tokens")).collect()):
        before.append((part, base))
        base += tokens
    parts = spark.createDataFrame(before, "part int, before long")
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("part", "segment", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("inside"))
    decoded = files.select("part", "segment", "payload").mapInArrow(_decode_task, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    both = decoded.join(F.broadcast(parts), "part").join(segments, ["part", "segment"])
    return both.select("doc_id", (F.col("before") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (to the shared folder unless ``path`` is given) and read them back.

    A null text counts as empty: its document is the end id alone. A null id stays null and
    comes first; repeated rows are written once each; an empty table gives no rows.
    """
    import uuid

    spark = prepare(docs.sparkSession)
    path = path or f"{shared_dir(spark)}/quern-token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col)
    return read_token_index(spark, path)
