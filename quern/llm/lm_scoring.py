"""Stupid-backoff scores of every document against all other documents, relationally.

Documents are dealt to parcels by hash. The texts of a parcel are exploded into their n-grams
of 1 to ``order`` words, named by hashes of their words' hashes: a row for each distinct n-gram
of a parcel, with the first place that it has there. They are dealt in runs by their hashes, of
which a parcel has them in order, exploded to rows there, and added up they are the count table; those that more than one document has (no other can be known to a document from the
rest of the corpus) are joined to the parcels that have them, and packed. To these tables, dealt by
parcel, with a row for each so many first places that follow each other, the places of all documents
are joined where they are, so that places are never shuffled as rows:
first the longest n-gram of a place, then of known ones the prefix, which divides, and of unknown
ones the suffix, to which the score backs off, and so on down. Inside a parcel an n-gram is named
by its first place: the first of a row's places and the parcel are a key of 64 bits, which Spark's
hash joins take as a number. Logarithms are summed for each document. A document's own n-grams are taken off the
counts, so each is judged by the rest. A frequent n-gram is a row of each parcel, not of each
place, so no task gathers it.

N-grams are counted in SLICES of their hashes and parcels are scored in ROUNDS, one after the
other. Every one of them is; that only bounds the disk that shuffles take at a time.

S(w | v) = c(v w) / c(v) if the n-gram is known, else 0.4 S(w | v without its first word), with
c(w) / N for a word alone and 1 / (N + 1) for one that no other document has. A place near a
document's start has no longer n-gram and pays nothing for that.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._hashes import parcels
from ._store import columns_or_null, discard, prepare, shuffle_partitions, stage

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a parcel, about; a task holds one.
PARCEL_BYTES = 24_000_000
#: Bytes of text whose places are worked out together.
TEXT_BYTES = 4_000_000
#: Slices of single words and pairs; longer n-grams have twice as many.
SLICES = 1
ROUNDS = 4
#: Numbers to choose from for each parcel.
_NAMES = 40 * ROUNDS
_SEED = 42
#: Primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


#: Numbers that are hashed together: few enough to stay in a core's cache.
_BLOCK = 1 << 14


def chained(seeds: np.ndarray | np.uint64, values: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte numbers, each with a seed of its own: as Spark's ``xxhash64`` goes on from column to column."""
    out = np.empty(len(values), dtype=np.uint64)
    for i in range(0, len(values), _BLOCK):
        own = slice(i, i + _BLOCK)
        out[own] = _chained(seeds[own] if np.ndim(seeds) else seeds, values[own])
    return out


def _chained(seeds: np.ndarray | np.uint64, values: np.ndarray) -> np.ndarray:
    x = (seeds + _P5 + np.uint64(8)) ^ (_rotated(values * _P2, 31) * _P1)
    x = _rotated(x, 27) * _P1 + _P4
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


class Places:
    """The places of all words of some texts, of which ``words`` has the hashes and ``sizes`` the numbers:
    for every length of n-gram the hash of the one that ends there, and whether the place has one."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, order: int):
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.hashes, self.there = {1: words}, {k: at >= k - 1 for k in range(1, order + 1)}
        chain = chained(np.uint64(_SEED), words)
        for k in range(2, order + 1):
            grams = np.zeros(len(words), dtype=np.uint64)
            grams[1:] = chained(chain[:-1], words[1:])
            self.hashes[k] = chain = grams


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: What to keep of eight bytes that begin with so many of a word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 64


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each has. A word's eight bytes at a time are chained to its length."""
    joined = b" ".join(texts).lower()
    padded = joined + bytes(8)
    edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[np.frombuffer(joined, dtype=np.uint8)], True]))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(joined) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    hashes = chained(size.astype(np.uint64), eight[begin] & _KEEP[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    for at in range(8, _LONG_WORD, 8):
        hashes[more] = chained(hashes[more], eight[begin[more] + at] & _KEEP[np.minimum(size[more] - at, 8)])
        more = more[size[more] > at + 8]
    for i in more.tolist():
        hashes[i] = xxhash.xxh64_intdigest(joined[begin[i] : begin[i] + size[i]], _SEED)
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begin, ends))


def _together(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which equal n-grams stand together, each in the order of its places, and where each begins.

    Sorted are numbers of which the upper bits are an n-gram's, the lower the place; n-grams that agree in
    the upper bits and differ in others are few, and are sorted once more.
    """
    bits = np.uint64(len(grams).bit_length())
    key = grams >> bits
    key <<= bits
    key |= np.arange(len(grams), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    key >>= bits
    found = grams[order]
    new = found[1:] != found[:-1]
    for u in np.unique(key[1:][new & (key[1:] == key[:-1])]):
        run = slice(np.searchsorted(key, u, "left"), np.searchsorted(key, u, "right"))
        order[run] = order[run][np.argsort(found[run], kind="stable")]
        found[run] = grams[order[run]]
        new[run.start : run.stop - 1] = found[run][1:] != found[run][:-1]
    return order, np.flatnonzero(np.r_[True, new][: len(grams)])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows, and how many each has: of lists, or of bytes, which the JVM copies as they are where it takes lists number by number."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy().astype(np.int64)
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    data, at = column.buffers()[2], np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, dtype=np.uint8)[at : at + sizes.sum()].view(np.uint64) if sizes.any() else np.empty(0, dtype=np.uint64), sizes // 8


def _held(batches: Iterable[pa.RecordBatch], *also: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[pa.Array]]]:
    """Each parcel: its number, the hashes of its words, the numbers of words of its texts, and other columns."""
    held: dict[int, list[pa.RecordBatch]] = defaultdict(list)
    for b in batches:
        slot = b.column("slot").to_numpy()
        for s in np.unique(slot).tolist():
            held[s].append(b if slot[0] == s == slot[-1] and (slot == s).all() else b.filter(pa.array(slot == s)))
    for s in sorted(held):
        parcel = held.pop(s)
        words, sizes = _numbers(pa.concat_arrays([b.column("words") for b in parcel]))
        yield s, words, sizes, [pa.concat_arrays([b.column(c) for b in parcel]) for c in also]


def _count_task(batches: Iterable[pa.RecordBatch], k: int, piece: int, pieces: int) -> Iterator[pa.RecordBatch]:
    """``(h, place, m)``: distinct n-grams of ``k`` words of each parcel, of one slice of all hashes. ``place``
    has the parcel in its upper half, the first place there in the lower, and is below zero if one text alone has the n-gram."""
    for s, words, sizes, _ in _held(batches):
        places = Places(words, sizes, k)
        grams = places.hashes[k]
        taken = np.flatnonzero(places.there[k] if pieces == 1 else places.there[k] & (grams % np.uint64(pieces) == np.uint64(piece)))
        order, first = _together(grams[taken])
        taken = taken[order]
        ends = np.r_[first[1:], len(taken)]
        at, m = taken[first], (ends - first).astype(np.int32)
        more = np.flatnonzero(m > 1)  # most n-grams stand at one place, and so in one text
        several = more[places.text[at[more]] != places.text[taken[ends[more] - 1]]]
        place = (at + (s << 32)) | np.int64(-1 << 63)
        place[several] &= np.int64((1 << 63) - 1)
        h = grams[at].view(np.int64)
        for i in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (h, place, m)], names=["h", "place", "m"])


def _run_task(batches: Iterable[pa.RecordBatch], k: int, piece: int, pieces: int, tasks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(task, slot, h, first, m)``: the rows of ``_count_task`` in arrays, each a run of hashes of one of the
    ``tasks``, which have equal ranges of them. ``first`` has its sign bit set if one text alone has the n-gram."""
    for b in _count_task(batches, k, piece, pieces):
        h, place = b.column("h").to_numpy(), b.column("place").to_numpy()
        to = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(len(tasks))) >> np.uint64(32)
        begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        edges = pa.array(np.r_[begin, len(h)].astype(np.int32))
        first = (place & ((1 << 31) - 1)).astype(np.int32) | np.where(place < 0, np.int32(-1 << 31), np.int32(0))
        slot = np.full(len(begin), (place[0] >> 32) & ((1 << 31) - 1), dtype=np.int32)
        lists = [pa.ListArray.from_arrays(edges, x) for x in (b.column("h"), pa.array(first), b.column("m"))]
        yield pa.RecordBatch.from_arrays([pa.array(tasks[to[begin].astype(np.int64)]), pa.array(slot), *lists], names=["task", "slot", "h", "first", "m"])


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Of every run of numbers, which ends where the next begins, the bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((values.itemsize * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _pack_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slot, first, c)``: for each parcel the first places and counts of the n-grams it has among those of a task, in order, four and eight bytes each."""
    held = [(b.column("place").to_numpy(), b.column("c").to_numpy()) for b in batches]
    if not sum(len(p) for p, _ in held):
        return
    place, c = map(np.concatenate, zip(*held))
    order = np.argsort(place)
    place, c = place[order], c[order]
    slot = (place >> 32).astype(np.int32)
    begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    ends = np.r_[begin, len(slot)]
    yield pa.RecordBatch.from_arrays([pa.array(slot[begin]), _bytes(place.astype(np.int32), ends), _bytes(c, ends)], names=["slot", "first", "c"])


def _block_task(batches: Iterable[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """``(slot, first, c)``: all counts of a parcel by first places, ``places`` of which that follow each other are a row; 0 where no known n-gram is."""
    held = defaultdict(list)
    for b in batches:
        for slot, *run in zip(*(b.column(name).to_pylist() for name in ("slot", "first", "c"))):
            held[slot].append(run)
    for slot in sorted(held):
        first, c = (np.frombuffer(b"".join(x), dtype=kind) for x, kind in zip(zip(*held.pop(slot)), (np.int32, np.int64)))
        counts = np.zeros((first.max() // places + 1, places), dtype=np.int64)
        counts.reshape(-1)[first] = c
        blocks = np.flatnonzero(counts.any(axis=1))
        for i in range(0, len(blocks), 128):
            own = blocks[i : i + 128]
            ends = pa.array(np.arange(0, (len(own) + 1) * places, places, dtype=np.int32))
            columns = [np.full(len(own), slot, dtype=np.int32), (own * places).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(ends, pa.array(counts[own].reshape(-1)))], names=["slot", "first", "c"])


def _named(places: Places, k: int) -> np.ndarray:
    """For every place of a parcel the first place of its n-gram of ``k`` words, in the upper half, and how often its text has that; -1 without one."""
    out = np.full(len(places.text), -1, dtype=np.int64)
    if k == 1:  # every place has a word
        taken, first = _together(places.hashes[k])
    else:
        taken = np.flatnonzero(places.there[k])
        order, first = _together(places.hashes[k][taken])
        taken = taken[order]
    size = np.diff(np.r_[first, len(taken)])
    at = taken[first] << 32
    once = size == 1
    out[taken[first[once]]] = at[once] | 1
    # What is left stands at several places, of which those of a text follow each other.
    left = taken[np.repeat(~once, size)]
    size, at = size[~once], at[~once]
    text, new = places.text[left], np.zeros(len(left), dtype=bool)
    new[1:] = text[1:] != text[:-1]
    new[np.cumsum(size) - size] = True
    own = np.diff(np.r_[np.flatnonzero(new), len(left)])
    out[left] = np.repeat(at, size) | np.repeat(own, own)
    return out


def _place_task(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """For each document what ``_named`` says of its places, for every length of n-gram."""
    for s, words, sizes, (row,) in _held(batches, "row"):
        places, lists = Places(words, sizes, order), []
        ends = np.r_[0, np.cumsum(sizes)]
        for k in range(1, order + 1):
            lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_named(places, k))))
            del places.hashes[k]  # a worker has little memory
        parcel = pa.RecordBatch.from_arrays([pa.array(np.full(len(row), s, dtype=np.int32)), row, *lists], names=["slot", "row", *_lists(order)])
        cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, ends[-1] + 1, 1 << 17)), len(row)])
        for i, j in itertools.pairwise(np.unique(np.r_[0, cuts]).tolist()):
            yield parcel.slice(i, j - i)


def _lists(order: int) -> list[str]:
    return [f"x{k}" for k in range(1, order + 1)]


def _parcelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """``(slot, row, doc_id, text)`` with the parcel and a number of each document, the number of parcels and the bytes of all texts.

    Parcels have numbers that Spark deals to one task each, so none waits behind another.
    """
    spark = docs.sparkSession
    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "binary"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = shuffle_partitions(spark, size, PARCEL_BYTES)
    names = F.array(*map(F.lit, _names(spark, slots)))
    rows = rows.withColumn("slot", F.get(names, F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")))
    return rows.withColumn("row", F.monotonically_increasing_id()), slots, size


def _names(spark: SparkSession, slots: int) -> list[int]:
    """Numbers that Spark deals to one of so many tasks each."""
    dealt = spark.range(_NAMES * slots).select(F.col("id").cast("int").alias("slot"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(slots)).alias("task"))
    dealt = dealt.where(F.col("slot") % ROUNDS == F.col("task") % ROUNDS)  # as many parcels in each round
    named = dict(dealt.groupBy("task").agg(F.min("slot")).collect())  # a row for each parcel
    return [named.get(i, i) for i in range(slots)]


@contextlib.contextmanager
def _set(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session, for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Files of a shuffle go with the query that wrote them; joins by parcel and n-gram are dealt by parcel alone.
_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: A folder for each round, written without a sort.
_CONF |= {"spark.sql.maxConcurrentOutputFileWriters": str(ROUNDS)}
#: A parcel is one row group, which no two tasks share; its dictionary of words is kept whole.
_PARQUET = {"compression": "zstd", "parquet.block.size": str(1 << 30), "parquet.dictionary.page.size": str(16 << 20)}
#: Runs of numbers hardly repeat in a file.
_COUNTS = {"compression": "zstd", "parquet.enable.dictionary#first": "false", "parquet.enable.dictionary#c": "false"}
#: Rows of numbers that go to Python at a time.
_NUMBERS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 15)}
#: First places, one after the other, whose counts are a row of a parcel's table.
_PLACES = 1 << 10


def _hash_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the hashes of its words in order, eight bytes each."""
    for b in batches:
        texts = [t or b"" for t in b.column("text").to_pylist()]
        for run in parcels(texts, TEXT_BYTES):
            words, sizes = _word_hashes(texts[run])
            ends = np.r_[0, np.cumsum(sizes)]
            own = [b.column(c).slice(run.start, run.stop - run.start) for c in ("slot", "row", "doc_id")]
            columns = [*own, pa.array(sizes), _bytes(words, ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "row", "doc_id", "n_words", "words"])


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """``(slot, row, doc_id, n_words, words, round)``, staged by parcels, the number of parcels and the bytes of all texts."""
    rows, slots, size = _parcelled(docs, id_col, text_col)
    hashed = rows.mapInArrow(_hash_task, "slot int, row long, doc_id long, n_words long, words binary")
    return _by_rounds(hashed.repartition(slots, "slot"), size, "word-hashes", **_PARQUET), slots, size


def _by_rounds(df: DataFrame, size: int, name: str, **options: str) -> DataFrame:
    """``df`` staged, with the round of each row's parcel in a column ``round``, by which it is read."""
    return stage(df.withColumn("round", F.col("slot") % ROUNDS % _times(ROUNDS, size)), name, ["round"], **options)


def _times(most: int, size: int) -> int:
    """Slices or rounds of texts of ``size`` bytes: few texts need fewer."""
    return max(1, min(most, math.ceil(size / PARCEL_BYTES)))


#: Sums of counts stay below; above them is counted whether one or more documents have an n-gram.
_ONE = 1 << 40


def _exploded(hashed: DataFrame, names: list[int], size: int, k: int) -> Iterator[DataFrame]:
    """By slices: the n-grams of ``k`` words of each parcel, ``(task, h, place, one)``, dealt by ranges of ``h`` in runs. Where
    ``one`` is added up, there stands the count, and whether more than one document has the n-gram."""
    slices, first = _times((1 + (k > 2)) * SLICES, size), F.col("first")
    place = F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(first.bitwiseAND((1 << 31) - 1).cast("long"))
    one = F.when(first < 0, F.lit(_ONE)).otherwise(F.lit(2 * _ONE)) + F.col("m")
    for piece in range(slices):
        task = functools.partial(_run_task, k=k, piece=piece, pieces=slices, tasks=np.array(names, dtype=np.int32))
        runs = hashed.select("slot", "words").mapInArrow(task, "task int, slot int, h array<long>, first array<int>, m array<int>")
        rows = runs.repartition(len(names), "task").select("task", "slot", F.posexplode("h").alias("i", "h"), "first", "m")
        rows = rows.select("task", "slot", "h", F.get("first", F.col("i")).alias("first"), F.get("m", F.col("i")).alias("m"))
        yield rows.select("task", "h", place.alias("place"), one.alias("one"))


def _known(df: DataFrame) -> DataFrame:
    """Of a table with tallies ``s`` those n-grams that more than one document has, with their counts ``c``."""
    return df.where(F.col("s") >= 2 * _ONE).withColumn("c", F.col("s").bitwiseAND(_ONE - 1))


def _gram_tables(hashed: DataFrame, slots: int, size: int, order: int) -> dict[int, list[DataFrame]]:
    """For each length ``(slot, first, c, round)``, by slices: the counts of all n-grams that more than one document has, for each parcel that has them, packed."""
    tables = defaultdict(list)
    names = _names(hashed.sparkSession, slots)
    for k in range(1, order + 1):
        for exploded in _exploded(hashed, names, size, k):
            # An n-gram's rows are no more than the parcels: one sort, of runs that are in order, takes the place of a count and a join with it.
            found = _known(exploded.withColumn("s", F.sum("one").over(Window.partitionBy("h", "task"))))
            packed = found.select("place", "c").mapInArrow(_pack_task, "slot int, first binary, c binary")
            with _set(hashed.sparkSession, **_NUMBERS):
                tables[k].append(_by_rounds(packed, size, "ngram-counts", **_COUNTS))
    return tables


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def ngram_counts(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """``(k, h, c)``: the count of every n-gram of up to ``order`` words that more than one document has."""
    prepare(docs.sparkSession)
    with _set(docs.sparkSession, **_CONF):
        rows = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        hashed, slots, size = _hashed(rows, "doc_id", "text")
        exploded = [(k, e) for k in range(1, order + 1) for e in _exploded(hashed, _names(docs.sparkSession, slots), size, k)]
        return _union([stage(_known(e.groupBy("task", "h").agg(F.sum("one").alias("s"))).select(F.lit(k).alias("k"), "h", "c"), "ngram-counts") for k, e in exploded])


def _kinds(order: int) -> list[str]:
    """Names of the counts of words scored at each step, from the longest."""
    names = {1: "n_singles", 2: "n_pairs", 3: "n_triples"}
    return [*[names.get(k, f"n_{k}_grams") for k in range(order, 0, -1)], "n_unseen"]


def _scored(hashed: DataFrame, tables: dict[int, DataFrame], slots: int, order: int) -> DataFrame:
    """``(doc_id, n_words, counts, value)`` of the documents of some parcels; no place is shuffled but in its document's arrays."""
    lists, blocks = ", ".join(f"{name} array<long>" for name in _lists(order)), functools.partial(_block_task, places=_PLACES)
    placed = hashed.select("slot", "row", "words").mapInArrow(functools.partial(_place_task, order=order), f"slot int, row long, {lists}")
    left = placed.repartition(slots, "slot").select("slot", "row", *_lists(order), F.posexplode("x1").alias("i", "x"))
    # x: the n-gram that ends at the place; p: that which ends before it, the prefix of a longer one.
    columns = [F.get(f"x{k}", F.col("i")).alias(f"x{k}") for k in range(2, order + 1)] + [F.get(f"x{k}", F.col("i") - 1).alias(f"p{k}") for k in range(1, order)]
    left = left.select("slot", "row", F.col("x").alias("x1"), *columns)
    # state: the length of the n-gram that is known, 0 until then; y: what is looked for at this step, the known one's prefix at the step after.
    left = left.withColumns({"state": F.lit(0), "value": F.lit(0.0), "y": F.col(f"x{order}")})
    for k in range(order, 0, -1):
        later = [f"{name}{j}" for j in range(k - 1, 0, -1) for name in "xp"]
        left = left.select("slot", "row", *later, "state", "value", "y", F.when(F.col("y") >= 0, F.shiftright("y", 32).bitwiseAND(-_PLACES).cast("int")).alias("first"))
        table = tables[k].select("slot", "first", "c").repartition(math.ceil(slots / ROUNDS), "slot").mapInArrow(blocks, "slot int, first int, c array<long>").repartition(slots, "slot")
        left = left.join(table.hint("shuffle_hash"), ["slot", "first"], "left")
        count = F.get("c", F.shiftright("y", 32).bitwiseAND(_PLACES - 1).cast("int"))
        left = left.withColumn("others", F.coalesce(count - F.col("y").bitwiseAND((1 << 32) - 1), F.lit(0)))
        known, open_ = F.col("state") == k + 1, F.col("state") == 0
        found = open_ & (F.col("others") > 0)
        log = F.log(F.greatest("others", F.lit(1)).cast("double"))
        step = F.when(known, -log).when(found, log).when(open_ & (F.col("y") >= 0) & F.lit(k > 1), math.log(BACKOFF)).otherwise(0.0)
        after = [F.when(found, F.col(f"p{k - 1}")).when(open_, F.col(f"x{k - 1}")).alias("y")] if k > 1 else []
        left = left.select("slot", "row", *later[2:], F.when(found, k).otherwise(F.col("state")).alias("state"), (F.col("value") + step).alias("value"), *after)
    kinds = dict(zip(range(order, -1, -1), _kinds(order)))
    sums = left.groupBy("slot", "row").agg(F.sum("value").alias("value"), *[F.count_if(F.col("state") == k).alias(name) for k, name in kinds.items()])
    docs = hashed.select("slot", "row", "doc_id", "n_words").repartition(slots, "slot")
    none = {"value": 0.0} | dict.fromkeys(kinds.values(), 0)
    return docs.join(sums.hint("shuffle_hash"), ["slot", "row"], "left").drop("slot", "row").fillna(none, subset=list(none))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``(doc_id, n_words, n_triples, n_pairs, n_singles, n_unseen, score)`` of every row (with the
    names of the n-grams up to ``order``).

    ``score`` is the mean natural logarithm of S over the document's words (A-Z in lower
    case, split at ASCII white space); the counts tell how many words were scored at each step. A
    text without words, or null, has a null score; a null id stays null; repeated rows count as
    documents of their own; an empty table gives no rows; other columns are not looked at.
    """
    spark, kinds = prepare(docs.sparkSession), _kinds(order)
    with _set(spark, **_CONF):
        hashed, slots, size = _hashed(docs, id_col, text_col)
        tables = _gram_tables(hashed, slots, size, order)
        mine = [F.col("round") == i for i in range(_times(ROUNDS, size))]
        scored = _union([stage(_scored(hashed.where(m), {k: _union(t).where(m) for k, t in tables.items()}, slots, order), "lm-scores") for m in mine])
        discard(hashed, *itertools.chain.from_iterable(tables.values()))
    total = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    rest = F.lit(total) - F.col("n_words")
    value = F.col("value") - F.col("n_singles") * F.log(F.greatest(rest, F.lit(1)).cast("double")) - F.col("n_unseen") * F.log(rest + 1.0)
    return scored.select("doc_id", "n_words", *kinds, F.when(F.col("n_words") > 0, value / F.col("n_words")).alias("score"))
