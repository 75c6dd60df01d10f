"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made once for each text and reduced to the distinct ones. Two that
differ in at most ``radius`` of 64 bits agree on all bits of some choice of blocks, so
each distinct fingerprint is dealt to the groups named by its blocks' values; that deals
the work to tasks and loses no pair. In a task all fingerprints, whatever the size of
their groups, stand in an index in order of group and Gray rank, in which neighbours
differ in few bits: runs of neighbours form nodes, runs of nodes upper nodes, and every
node keeps the groups below it and the bits that all below it share (mask and pattern),
less those its parent has. A search goes down from the top, adds up the differing shared
bits, and drops a node and all below it when it holds other groups only, when the sum
passes the radius, or when all below it already belong to the searcher's component. A
task returns the forest of the links it found, not the links, so its output stays below
its input. Connected components then run over those forests.

``keep_one_each`` has a contract of its own: texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more are linked. No radius of a 64-bit SimHash promises that, so
its links are only first candidates. The others come from prefixes: with shingles in one order
for all texts, sets that similar share one of the first ``n - ceil(0.8 n) + 1``. Candidates are
checked on their words' shingles, first one or two for each text, then every pair that is left
in different components, so that a large group of copies is not checked pair by pair. Texts
that share a passage and little else meet in many such pairs; parity bitmaps of their sets
(Sandes et al., "Bitmap filter") tell most of them apart without their texts: two sets differ
in at least as many shingles as their bitmaps differ in bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components, local_components
from ._hashes import MIX, mix, parcels
from ._store import columns_or_null, discard, frequent, join_spread, prepare, shuffle_partitions, stage

FINGERPRINT_BITS = 64
SHINGLE_SEED = 42
#: Consecutive fingerprints or nodes below a node.
FAN_OUT = 8
#: Whole groups that make up one index, in rows; a larger group has one of its own.
INDEX_ROWS = 32_768
#: Larger groups are cut into chunks of this many, and every pair of chunks is its own group.
GROUP_ROWS = 20_000
#: Searches run together while they have at most so many rows of their groups before them.
SEARCH_PAIRS = 1_000_000
#: Bytes of text that are hashed together.
TEXT_BYTES = 4_000_000
#: Texts, at most about, in which common shingles are looked for; those in at least
#: HOT_TEXTS of them (HOT_GRAMS at most) stand last in the order of shingles.
SAMPLE_ROWS = 20_000
HOT_TEXTS = 5
HOT_GRAMS = 100_000
#: Texts of candidates are found by a broadcast of up to so many of their ids, else by a join.
BROADCAST_NODES = 200_000
#: Rounds in which a text is checked with one other, before all pairs that are left.
STAR_ROUNDS = 2
_ROUNDING = 1e-9


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """Hash of the shingle at each place of a UTF-8 text; a shorter text is one shingle."""
    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return np.array([digest(joined, SHINGLE_SEED)] if words else [], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1 :].tolist()
    return np.fromiter((digest(joined[s:e], SHINGLE_SEED) for s, e in zip(starts, ends)), dtype=np.uint64, count=len(starts))


def _fold(hashes: np.ndarray) -> int:
    counts, n = np.zeros(FINGERPRINT_BITS, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, FINGERPRINT_BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def simhash(text: bytes, shingle_words: int = 3) -> int:
    """Fingerprint of a UTF-8 text: bit set if set in over half the shingle hashes."""
    return _fold(shingle_hashes(text, shingle_words))


def _fingerprint_task(batches: Iterable[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t or b"", shingle_words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; a null text counts as empty."""
    prepare(docs.sparkSession)
    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "binary"))
    return rows.mapInArrow(lambda batches: _fingerprint_task(batches, shingle_words), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchical index over 64-bit fingerprints that stand by group, then in Gray order."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray | None = None, fan_out: int = FAN_OUT):
        self.prints, self.fan_out = prints, fan_out
        self.groups = np.zeros(len(prints), dtype=np.int64) if groups is None else groups
        ones, any_, first, last = [prints], [prints], [self.groups], [self.groups]
        while len(ones[-1]) > fan_out:
            at = np.arange(0, len(ones[-1]), fan_out)
            ones.append(np.bitwise_and.reduceat(ones[-1], at))
            any_.append(np.bitwise_or.reduceat(any_[-1], at))
            last.append(last[-1][np.minimum(at + fan_out, len(first[-1])) - 1])
            first.append(first[-1][at])
        mask = [~(o ^ a) for o, a in zip(ones, any_)]
        # Bits that a node shares and its parent does not: each bit counts once on a path.
        self.own = [m & ~np.repeat(up, fan_out)[: len(m)] for m, up in zip(mask, mask[1:])] + [mask[-1]]
        self.pattern, self.first, self.last = ones, first, last

    def _blocks(self) -> list[int]:
        """Ends of runs of searches with SEARCH_PAIRS rows of their groups before them at most."""
        n = len(self.prints)
        behind = np.cumsum(np.searchsorted(self.groups, self.groups, side="right") - np.arange(n))
        ends = [0]
        while ends[-1] < n:
            done = behind[ends[-1] - 1] if ends[-1] else 0
            ends.append(max(ends[-1] + 1, int(np.searchsorted(behind, done + SEARCH_PAIRS, side="right"))))
        return ends

    def links(self, radius: int) -> np.ndarray:
        """A label for each fingerprint: equal for those connected by links within radius and group."""
        n, labels, top = len(self.prints), np.arange(len(self.prints)), len(self.pattern) - 1
        blocks = self._blocks()
        for begin, end in zip(blocks, blocks[1:]):
            low, high = [labels], [labels]
            for _ in range(top):
                cut = np.arange(0, len(low[-1]), self.fan_out)
                low.append(np.minimum.reduceat(low[-1], cut))
                high.append(np.maximum.reduceat(high[-1], cut))
            query, node = (x.ravel() for x in np.meshgrid(np.arange(begin, end), np.arange(len(self.pattern[top])), indexing="ij"))
            far = np.zeros(len(query), dtype=np.int64)
            for level in range(top, -1, -1):
                # Only what stands behind the query in its group; not what is all in its component already.
                group = self.groups[query]
                keep = ((node + 1) * self.fan_out**level > query + 1) & (self.first[level][node] <= group) & (group <= self.last[level][node])
                keep &= (low[level][node] != high[level][node]) | (low[level][node] != labels[query])
                query, node, far = query[keep], node[keep], far[keep]
                far = far + np.bitwise_count((self.prints[query] ^ self.pattern[level][node]) & self.own[level][node])
                keep = far <= radius
                query, node, far = query[keep], node[keep], far[keep]
                if level:
                    child = node[:, None] * self.fan_out + np.arange(self.fan_out)
                    inside = child < len(self.pattern[level - 1])
                    query, far = np.repeat(query, self.fan_out)[inside.ravel()], np.repeat(far, self.fan_out)[inside.ravel()]
                    node = child[inside]
            labels = local_components(n, query, node, labels)
        return labels


def forest(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(fingerprint, root)`` that connect what is linked within equal keys."""
    order = np.lexsort((gray_rank(prints), keys))
    keys, prints = keys[order], prints[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    roots, begin = np.arange(len(keys)), 0
    while begin < len(keys):
        # Whole groups up to INDEX_ROWS, one at least.
        fit = np.searchsorted(ends, begin + INDEX_ROWS, side="right")
        end = int(ends[max(fit - 1, np.searchsorted(starts, begin))])
        roots[begin:end] = begin + GrayIndex(prints[begin:end], keys[begin:end]).links(radius)
        begin = end
    # Over the whole task a fingerprint is one node, whatever groups it stands in.
    nodes, at = np.unique(prints, return_inverse=True)
    labels = local_components(len(nodes), at, at[roots])
    joined = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[joined], nodes[labels[joined]]


def _link_task(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    read = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
    if read:
        keys, prints = (np.concatenate(x) for x in zip(*read))
        if len(keys):
            a, b = forest(keys, prints.view(np.uint64), radius)
            for at in range(0, len(a), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(a[cut].view(np.int64)), pa.array(b[cut].view(np.int64))], names=["a", "b"])


def block_masks(radius: int, rows: int) -> list[int]:
    """Masks of which every pair within ``radius`` agrees on one: all choices of
    ``blocks - radius`` of equal blocks, with more blocks (and longer keys) for more rows."""
    for blocks in range(radius + 1, radius + 4):
        if rows >> (FINGERPRINT_BITS * (blocks - radius) // blocks) <= 4096:
            break
    cuts = [FINGERPRINT_BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(keyed: DataFrame, item: str, group_rows: int) -> DataFrame:
    """``keyed`` with groups of a ``key`` over ``group_rows`` dealt anew for every pair of chunks."""
    columns = [c for c in keyed.columns if c != "key"]
    hot = stage(keyed.groupBy("key").count().where(F.col("count") > group_rows), "hot-groups")
    if hot.isEmpty():
        return keyed
    chunks = F.ceil(F.col("count") / F.lit(group_rows)).cast("int")
    own = F.pmod(F.xxhash64(item), F.col("chunks")).cast("int")
    dealt = keyed.join(hot.select("key", chunks.alias("chunks")), "key", "left").withColumn("own", own)
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("other", other)
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(*columns, F.when(F.col("chunks").isNull(), F.col("key")).otherwise(pair).alias("key"))


def near_links(distinct: DataFrame, rows: int, radius: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what links within ``radius`` connect.

    ``distinct(fp)`` holds each fingerprint once. Groups over ``group_rows`` are cut into
    chunks and dealt anew for every pair of chunks, so that no task holds a large group.
    """
    spark, masks = distinct.sparkSession, block_masks(radius, rows)
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])).alias("key")
    )
    keyed = _deal(keyed, "fp", group_rows)
    parts = shuffle_partitions(spark, rows * len(masks))
    return keyed.repartition(parts, "key").mapInArrow(lambda batches: _link_task(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row.

    ``component_id`` is the smallest id reachable over links, the row's own included. Texts
    without words have fingerprint zero and link like any other; a null text counts as
    empty; a null id stays null and never becomes a component's id unless all its ids are
    null; repeated rows are returned once each; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    links = near_links(distinct.select("fp"), distinct.count(), radius, group_rows)
    roots = stage(components(links), "roots")
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stage(known.join(least, "root").select("fp", "component_id"), "named-fingerprints")
    return join_spread(prints, named, "fp", frequent(distinct, "fp")).select("doc_id", "fp", "component_id")


def _prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - _ROUNDING) + 1 if n else 0


def text_grams(texts: list[bytes], shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, gram)`` of every shingle of several texts, by text; repeats included.

    A gram is made of its words' hashes. A text of fewer words is one shingle; one without
    words has none.
    """
    index: dict[bytes, int] = {}
    words = [[index.setdefault(w, len(index)) for w in t.lower().split()] for t in texts]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SHINGLE_SEED) for w in index), dtype=np.uint64, count=len(index))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    text = np.repeat(np.arange(len(texts)), sizes)
    single = hashes[np.fromiter(itertools.chain.from_iterable(words), dtype=np.int64, count=len(text))]
    grams = single[: max(len(single) - shingle_words + 1, 0)]
    for j in range(1, shingle_words):
        grams = mix(grams * MIX[0] + single[j : j + len(grams)])
    whole = text[: len(grams)] == text[len(text) - len(grams) :]
    grams, text = grams[whole], text[: len(grams)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < shingle_words))
    if len(short):
        joined = (b" ".join(texts[i].lower().split()) for i in short)
        text = np.r_[text, short]
        grams = np.r_[grams, np.fromiter((xxhash.xxh64_intdigest(t, SHINGLE_SEED + 1) for t in joined), dtype=np.uint64, count=len(short))]
        order = np.argsort(text, kind="stable")
        text, grams = text[order], grams[order]
    return text, grams


def _parity_bitmaps(text: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each text a bitmap of 64 bits, or of twice, four times ... as many, at least its shingles;
    a bit tells whether an odd number of the distinct shingles fall on it."""
    width = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / 64))).astype(np.int64)
    starts = np.cumsum(width) - width
    at = starts[text] + (mix(grams ^ MIX[0]) & (width[text] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(width.sum())) & 1, bitorder="little").tobytes()
    return [packed[a // 8 : (a + w) // 8] for a, w in zip(starts.tolist(), width.tolist())]


def _folds(text: np.ndarray, grams: np.ndarray, texts: int) -> np.ndarray:
    """SimHash of each text from all its grams, which stand by text."""
    counts, step = np.zeros((texts, FINGERPRINT_BITS), dtype=np.int64), 1 << 16
    for at in range(0, len(grams), step):
        own = text[at : at + step]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(grams[at : at + step].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, FINGERPRINT_BITS)
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = 2 * counts > np.bincount(text, minlength=texts)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _hot_task(batches: Iterable[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        for part in parcels(texts, TEXT_BYTES):
            text, grams = text_grams(texts[part], shingle_words)
            order = np.lexsort((grams, text))
            text, grams = text[order], grams[order]
            once = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])][: len(grams)]
            yield pa.RecordBatch.from_arrays([pa.array(grams[once].view(np.int64))], names=["gram"])


def _hot_grams(rows: DataFrame, shingle_words: int) -> np.ndarray:
    """Common shingles, by a sample of the texts. Any set gives the same links."""
    one_in = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text")
    grams = some.mapInArrow(lambda b: _hot_task(b, shingle_words), "gram long").groupBy("gram").count().where(F.col("count") >= HOT_TEXTS)
    found = grams.orderBy(F.desc("count"), "gram").limit(HOT_GRAMS).select("gram").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def _set_task(batches: Iterable[pa.RecordBatch], shingle_words: int, similarity: float, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = [t or b"" for t in batch.column("text").to_pylist()]
        for rows in parcels(every, TEXT_BYTES):
            texts = every[rows]
            text, grams = text_grams(texts, shingle_words)
            prints = _folds(text, grams, len(texts))
            common = np.zeros(len(grams), dtype=bool)
            if len(hot):
                common = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
            order = np.lexsort((grams, common, text))
            text, grams = text[order], grams[order]
            once = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])][: len(grams)]
            text, grams = text[once], grams[once]
            sizes = np.bincount(text, minlength=len(texts))
            starts = np.cumsum(sizes) - sizes
            nodes = np.zeros(len(texts), dtype=np.uint64)
            np.add.at(nodes, text, mix(grams + MIX[0]))  # a sum does not depend on the order
            nodes = mix(nodes + sizes.astype(np.uint64))
            first = np.array([_prefix_length(n, similarity) for n in sizes.tolist()], dtype=np.int64)
            inside = np.arange(len(grams)) - starts[text] < first[text]
            bits = _parity_bitmaps(text, grams, sizes)
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first)], pa.int32()), pa.array(grams[inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], batch.column("b")[rows], pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), prefix],
                names=["doc_id", "b", "node", "fp", "n", "bits", "prefix"],
            )


def _read(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray] | None:
    read = [[b.column(n).to_numpy() for n in names] for b in batches]
    return [np.concatenate(x) for x in zip(*read)] if read else None


def _shared_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose gram another row has."""
    names = ("gram", "node", "n", "at")
    if (read := _read(batches, names)) is not None:
        order = np.argsort(read[0], kind="stable")
        same = read[0][order][1:] == read[0][order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        for at in range(0, len(order), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[order[at : at + (1 << 16)]]) for x in read], names=list(names))


def _possible(n, at, other_n, other_at, similarity: float, least):
    """Whether sets whose first common gram stands at these places can be similar enough."""
    return 1 + least(n - at - 1, other_n - other_at - 1) >= similarity / (1 + similarity) * (n + other_n) - _ROUNDING


class _Bitmaps:
    """Parity bitmaps of the rows of a group, by width."""

    def __init__(self, bits: list[bytes]):
        self.width = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits)) // 8
        self.place, self.rows = np.empty(len(bits), dtype=np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(bits[k] for k in own.tolist()), dtype="<u8").reshape(len(own), w)

    def least_differences(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which row ``i``'s bitmap differs from others', which are no narrower; a wider one
        is folded onto the narrower."""
        w = int(self.width[i])
        mine, out = self.rows[w][self.place[i]], np.empty(len(others), dtype=np.int64)
        for wide in np.unique(self.width[others]).tolist():
            these = np.flatnonzero(self.width[others] == wide)
            folded = np.bitwise_xor.reduce(self.rows[wide][self.place[others[these]]].reshape(len(these), wide // w, w), axis=1)
            out[these] = np.bitwise_count(folded ^ mine).sum(axis=1)
        return out


def _cross_task(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs with a common gram that can be similar and stand in different components."""
    read, bits = [], []
    for b in batches:
        read.append([b.column(n).to_numpy() for n in ("key", "node", "n", "at", "root")])
        bits += b.column("bits").to_pylist()
    if not bits:
        return
    key, node, n, at, root = (np.concatenate(x) for x in zip(*read))
    order = np.lexsort((n, key))
    key, node, n, at, root = (x[order] for x in (key, node, n, at, root))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    most = (1 - similarity) / (1 + similarity)
    for start, end in zip(starts[mixed].tolist(), ends[mixed].tolist()):
        maps = _Bitmaps([bits[k] for k in order[start:end].tolist()])
        # Rows stand by size: the first that is too large ends a search.
        last = start + np.searchsorted(n[start:end], n[start:end] / similarity + _ROUNDING, side="right")
        for i in range(start, end - 1):
            j = np.arange(i + 1, last[i - start])
            j = j[(root[j] != root[i]) & _possible(n[i], at[i], n[j], at[j], similarity, np.minimum)]
            if len(j):
                j = j[maps.least_differences(i - start, j - start) <= most * (n[i] + n[j]) + _ROUNDING]
            if len(j):
                low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _check_task(batches: Iterable[pa.RecordBatch], shingle_words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of the pairs that are similar a forest: a pair whose texts earlier ones connect is not looked at."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    def grams(text: bytes | None) -> np.ndarray:
        return np.unique(text_grams([text or b""], shingle_words)[1])

    hub, held = None, None
    for batch in batches:
        good = []
        columns = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        for a, b, first, second in zip(*columns):
            ra, rb = root(a), root(b)
            if ra != rb:
                if a != hub:
                    hub, held = a, grams(first)
                other = grams(second)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if both >= similarity * (len(held) + len(other) - both) - _ROUNDING:
                    up[rb] = ra
                    good.append(True)
                    continue
            good.append(False)
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def similar_components(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(doc_id, b, stands)`` of every row; ``b`` is the text's hash.

    Texts are linked if their sets of shingles have a Jaccard similarity of ``similarity`` or
    more; all such pairs are linked. Texts without words, null ones included, are equal.
    ``stands`` is ``(no_id, doc_id, b)`` of the row that stands for the component: that with
    the smallest id, null ids last, and among rows of one id that with the smallest text hash.
    Repeated rows are returned once each; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = columns_or_null(docs, doc_id=("doc_id", "long"), text=("text", "binary")).withColumn("b", F.xxhash64("text"))
    hot = _hot_grams(rows, shingle_words)
    schema = "doc_id long, b long, node long, fp long, n int, bits binary, prefix array<long>"
    sets = stage(rows.mapInArrow(lambda x: _set_task(x, shingle_words, similarity, hot), schema), "shingle-sets")
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "b")).alias("stands")
    nodes = stage(sets.groupBy("node").agg(stands, F.count(F.lit(1)).alias("rows"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "distinct-sets")
    grams = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]

    entries = nodes.select("node", "n", F.posexplode("prefix").alias("at", "gram")).select("gram", "node", "n", "at")
    entries = entries.repartition(shuffle_partitions(spark, grams), "gram")
    shared = stage(entries.mapInArrow(_shared_task, "gram long, node long, n int, at int"), "shared-grams")

    def checked(pairs: DataFrame) -> DataFrame:
        """The similar ones of ``pairs``; only their own texts are brought together."""
        pairs = stage(pairs, "candidate-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = stage(nodes.select("node", "stands").join(ends, "node").select("node", F.col("stands.doc_id").alias("_id"), F.col("stands.b").alias("_b")), "wanted-texts")
        few = wanted.count() <= BROADCAST_NODES
        texts = rows.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(wanted["_id"]) & rows["b"].eqNullSafe(wanted["_b"]))
        texts = stage(texts.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        out = stage(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _check_task(x, shingle_words, similarity), "a long, b long"), "similar-pairs")
        discard(pairs, wanted, texts)
        return out

    def labelled(found: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return found.withColumn("root", F.col("node"))
        return found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def by_fingerprint() -> DataFrame:
        distinct = stage(nodes.select("fp").distinct(), "distinct-fingerprints")
        near = stage(components(near_links(distinct, distinct.count(), radius, group_rows)), "roots")
        known = nodes.select("node", "fp").join(near.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        hubs = known.groupBy("root").agg(F.min("node").alias("a"))
        return known.join(hubs, "root").where("a <> node").select("a", F.col("node").alias("b"))

    def by_star(found: DataFrame, salt: int) -> DataFrame:
        # First the text with the fewest rare shingles before the common one, which edited copies have
        # more of; then any.
        first = [F.col("at").alias("first")] if salt == 0 else []
        hub = F.min(F.struct(*first, F.xxhash64(F.lit(salt), "node").alias("h"), "node", "n", "at", "root")).alias("hub")
        both = found.join(found.groupBy("gram").agg(hub), "gram").where(F.col("root") != F.col("hub.root"))
        both = both.where(_possible(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"), similarity, F.least))
        votes = both.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
        return votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")

    links, roots = None, None
    for round in range(STAR_ROUNDS + 1):
        found = labelled(shared, roots)
        if round < STAR_ROUNDS:
            pairs = by_star(found, round)
            pairs = pairs if round else pairs.union(by_fingerprint()).distinct()
        else:
            # Grams whose texts are one component by now have nothing left to tell.
            mixed = found.groupBy("gram").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("gram")
            left = found.join(mixed, "gram", "left_semi").join(nodes.select("node", "bits"), "node")
            left = stage(left.withColumnRenamed("gram", "key"), "mixed-grams")
            keyed = _deal(left, "node", group_rows).repartition(shuffle_partitions(spark, grams), "key")
            pairs = keyed.mapInArrow(lambda x: _cross_task(x, similarity), "a long, b long").distinct()
        new = checked(pairs)
        links = new if links is None else links.union(new)
        roots = stage(components(links), "roots")
    known = labelled(nodes.select("node", "stands"), roots)
    least = known.groupBy("root").agg(F.min("stands").alias("stands"))
    named = stage(known.drop("stands").join(least, "root").select("node", "stands"), "named-sets")
    hot = stage(frequent(nodes, "node"), "frequent-sets")
    discard(nodes, shared)
    return join_spread(sets.select("doc_id", "b", "node"), named, "node", hot).select("doc_id", "b", "stands")


def keep_one_each(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` less all but one document of each component of similar texts.

    That with the smallest id stays (null ids last; among rows of one id, that with the
    smallest text hash), so rows that repeat an id with different texts are documents of their
    own. Of rows that repeat both, one stays. Null and wordless texts are equal. An empty table
    gives no rows; other columns are passed on, whatever their names.
    """
    found = similar_components(docs, shingle_words, similarity)
    other = ~F.col("doc_id").eqNullSafe(F.col("stands.doc_id")) | ~F.col("b").eqNullSafe(F.col("stands.b"))
    gone = found.where(other).select(F.col("doc_id").alias("_quern_id"), F.col("b").alias("_quern_hash")).distinct()
    gone = stage(gone, "near-duplicates").hint("shuffle_hash")
    same = F.xxhash64(docs["text"].cast("binary"))
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_quern_id"]) & same.eqNullSafe(gone["_quern_hash"]), "left_anti")
    twice = kept.select("doc_id", same.alias("b")).groupBy("doc_id", "b").count().where("count > 1")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy("doc_id", F.xxhash64(F.col("text").cast("binary"))).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn("_quern_at", F.row_number().over(order)).where("_quern_at = 1").drop("_quern_at")
