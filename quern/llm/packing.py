"""Sum-of-squares online packing of documents into fixed token windows.

A document's ids are cut into full windows and one tail. The tail goes, as soon as it
is seen, to the fill level that keeps the sum of squared counts of partially filled
windows least (Csirik et al., "On the sum-of-squares algorithm for bin packing"); the
counts stand in one array indexed by level. What is open at a task's end is closed by
cutting the emptiest windows' pieces into the gaps of the fullest, so a task leaves one
padded window at most. Every task packs the rows of its own partition: no shuffle, and
memory is bounded by the open windows, of which there are a few for each level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._store import columns_or_null, prepare
from ._tokens import ID_BYTES, encoder, pack_ids

#: Sequence ids are the task's partition number times this, plus a counter.
SEQUENCES_PER_TASK = 1 << 33

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens int, padded_to int, at_close boolean"
)


class SumOfSquares:
    """Level array of partially filled windows of ``capacity`` units.

    ``counts[h]`` windows are filled to level ``h``. ``place`` returns the level to add
    an item to (0: a new window); ties go to the fullest level.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1)
        # A window that becomes full leaves the sum: half a unit cheaper than an empty level.
        self.counts[capacity] = -0.5

    def place(self, size: int) -> int:
        c, top = self.counts, self.capacity - size
        cost = np.where(c[1 : top + 1] > 0, c[1 + size : self.capacity + 1] - c[1 : top + 1] + 1.0, np.inf)
        best = 0
        if len(cost):
            last = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[last] <= c[size] + 0.5:
                best = last + 1
        if best:
            c[best] -= 1
        if best + size < self.capacity:
            c[best + size] += 1
        return best


def padded_length(tokens: int, capacity: int) -> int:
    """Length of a sequence once padded: a power of two stays, all else grows to ``capacity``."""
    return tokens if tokens and tokens & (tokens - 1) == 0 else capacity


class Packer:
    """Packs packed-id documents into windows; yields closed windows as piece lists.

    A piece is ``(doc key, start, ids, document tokens)``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.bytes = capacity, capacity * ID_BYTES
        self.levels = SumOfSquares(capacity)
        self.open: dict[int, list[list]] = {}

    def add(self, key, ids: bytes) -> Iterator[list]:
        total = len(ids) // ID_BYTES
        cut = len(ids) - len(ids) % self.bytes
        for at in range(0, cut, self.bytes):
            yield [(key, at // ID_BYTES, ids[at : at + self.bytes], total)]
        if cut == len(ids):
            return
        size = (len(ids) - cut) // ID_BYTES
        level = self.levels.place(size)
        window = self.open[level].pop() if level else []
        window.append((key, cut // ID_BYTES, ids[cut:], total))
        if level + size == self.capacity:
            yield window
        else:
            self.open.setdefault(level + size, []).append(window)

    def close(self) -> Iterator[list]:
        """Close all open windows, filling the fullest from the emptiest."""
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        fill = [level for level in sorted(self.open, reverse=True) for _ in self.open[level]]
        self.open = {}
        first, last = 0, len(left) - 1
        while first < last:
            gap = self.capacity - fill[first]
            while gap and first < last:
                key, start, ids, total = left[last].pop()
                take = min(gap, len(ids) // ID_BYTES)
                keep = len(ids) - take * ID_BYTES
                left[first].append((key, start + keep // ID_BYTES, ids[keep:], total))
                if keep:
                    left[last].append((key, start, ids[:keep], total))
                gap -= take
                fill[first] += take
                fill[last] -= take
                if not fill[last]:
                    last -= 1
            if gap == 0:
                yield left[first]
                first += 1
        if first == last and left[first]:
            yield left[first]


def _pack_task(batches: Iterable[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, packer, end = encoder(tokenizer), Packer(capacity), pack_ids([end_id])
    base = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
    done, held = 0, []
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int32()), ("padded_to", pa.int32()), ("at_close", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def flush() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
        held = []
        return out

    def keep(window: list, at_close: bool = False) -> None:
        nonlocal done
        at, tokens = 0, sum(len(p[2]) for p in window) // ID_BYTES
        for key, start, ids, total in window:
            n = len(ids) // ID_BYTES
            row = (key, start, n, zlib.crc32(ids), total, base + done, at, tokens, padded_length(tokens, capacity), at_close)
            held.append(row + (ids,) if with_ids else row)
            at += n
        done += 1

    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for window in packer.add(key, enc.encode(text) + end):
                keep(window)
            if len(held) >= 4096:
                yield flush()
    for window in packer.close():
        keep(window, at_close=True)
        if len(held) >= 4096:
            yield flush()
    if held:
        yield flush()


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence.

    Every id of every document, the end id included, lies in exactly one piece. A null
    text is an empty one (its document is the end id alone); a null id stays null;
    repeated rows are packed once each; an empty table gives no rows; other columns are
    not looked at. ``with_ids`` adds the piece's ids as little-endian uint32. ``at_close`` marks
    sequences that were made of what was open when their task ended; their number is bounded
    by the levels, so their share falls as partitions grow.
    """
    prepare(docs.sparkSession)

    def task(batches):
        return _pack_task(batches, tokenizer, capacity, end_id, with_ids)

    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return rows.mapInArrow(task, PIECE_SCHEMA + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """Materialise sequences from pieces that carry ``ids``: one row for each sequence,
    its ids in order and the lengths of the documents' pieces in it."""
    from pyspark.sql import functions as F

    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id", "padded_to").agg(ordered.alias("p"))
    return grouped.select(
        "sequence_id", "padded_to",
        F.expr("aggregate(transform(p, x -> x.ids), X'', (a, b) -> concat(a, b))").alias("ids"),
        F.expr("transform(p, x -> x.length)").alias("piece_lengths"),
        F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"),
    )
