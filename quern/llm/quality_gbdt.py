"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are worked out where the text is; the trees are grown with
numpy on a bounded sample of labelled rows, level by level from histograms of binned
statistics, and flattened into arrays by which numpy walks all rows through all trees
at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import columns_or_null, prepare

#: Most labelled rows the trees are grown on; the documented bound of the sample.
MAX_TRAINING_ROWS = 20_000
#: Rows are held out where crc32 of the id as text leaves this remainder.
FOLDS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.7

_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "blank": b" \t", "newline": b"\n\r", "stop": b".", "comma": b",", "exclaim": b"!", "question": b"?",
    "colon": b":;", "quote": b"'\"`", "dash": b"-_", "bar": b"|", "hash": b"#", "star": b"*", "dollar": b"$",
    "percent": b"%", "amp": b"&", "angle": b"<>", "bracket": b"()[]{}", "slash": b"/\\", "other_symbol": b"=+@~^",
}
BYTE_CLASSES = np.zeros((256, len(_GROUPS) + 2))
for _i, _members in enumerate(_GROUPS.values()):
    BYTE_CLASSES[list(_members), _i] = 1
BYTE_CLASSES[0xC0:, len(_GROUPS)] = 1  # first bytes of letters beyond ASCII
BYTE_CLASSES[list(range(9)) + [11, 12, *range(14, 32), 127], len(_GROUPS) + 1] = 1

WORD_STATISTICS = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "distinct_pairs", "same_as_before", "top_word", "capitals",
    "ends_marked", "short_words", "long_words", "distinct_lines", "log_lines", "mean_line", "byte_entropy",
)
STATISTICS = (*_GROUPS, "letter_start", "control", *WORD_STATISTICS)


def statistics(text: bytes) -> np.ndarray:
    """The document statistics of one UTF-8 text; all zero for an empty one."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts / len(text)
    out[: BYTE_CLASSES.shape[1]] = share @ BYTE_CLASSES
    words, seen = text.split(), share[share > 0]
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    tail = np.zeros(len(WORD_STATISTICS))
    tail[0], tail[14] = np.log1p(len(text)), -(seen * np.log(seen)).sum()
    if n:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        last = np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        tail[1:11] = (
            np.log1p(n), lengths.mean(), len(tally) / n, len(set(zip(words, words[1:]))) / max(n - 1, 1),
            sum(map(bytes.__eq__, words, words[1:])) / n, max(tally.values()) / n, sum(map(bytes.isupper, words)) / n,
            np.isin(last, np.frombuffer(b"!?#*$%&|<>", dtype=np.uint8)).mean(), (lengths <= 2).mean(), (lengths >= 14).mean(),
        )
        tail[11:14] = len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(text) / len(lines))
    out[BYTE_CLASSES.shape[1] :] = tail
    return out


class FlatTrees:
    """Trees of one depth as arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    def __init__(self, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray, bias: float):
        self.features, self.cuts, self.leaves, self.bias = features, cuts, leaves, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.features))
        if not len(trees):
            return np.full(len(x), self.bias)
        node, row = np.zeros((len(x), len(trees)), dtype=np.int64), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaves.shape[1]))):
            right = x[row, self.features[trees, node]] > self.cuts[trees, node]
            node = 2 * node + 1 + right
        return self.bias + self.leaves[trees, node - self.features.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least_weight: float = 2.0) -> FlatTrees:
    """Boost ``trees`` trees for the logistic loss. Without rows, or with one label only,
    the score is the smoothed share of label 1."""
    n, k = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    share = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    inner, leaves_n = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return FlatTrees(np.empty((0, inner), dtype=np.int64), np.empty((0, inner)), np.empty((0, leaves_n)), bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(k) * bins
    margin = np.full(n, bias)
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (k * bins) + flat).ravel()
            g = np.bincount(slot, np.repeat(grad, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hess, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least_weight) | (h_all - h < least_weight)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, at = divmod(int(b), bins)
                if gain[i, f, at] > 1e-9 and at < len(edges[f]):
                    feature[first + i], cut[first + i] = f, edges[f][at]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves_n) / (np.bincount(leaf, hess, leaves_n) + ridge)
        margin += value[leaf]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(value)
    return FlatTrees(np.array(all_features), np.array(all_cuts), np.array(all_leaves), bias)


def _statistics_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t or b"") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("u"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "u", "x"])


def _score_task(batches: Iterable[pa.RecordBatch], model: FlatTrees) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t or b"") for t in b.column("text").to_pylist()]
        score = model.score(np.array(rows).reshape(len(rows), len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS, **options) -> FlatTrees:
    """Fit on labelled rows that are not held out, at most ``max_rows`` of them, those least by
    a hash of id and text. An id labelled more than once counts with its larger label; rows that
    repeat an id are rows of their own, and of rows that repeat id and text one counts. Null ids,
    null labels and labels without a document are left out; a null text counts as empty."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("i").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("i"))).groupBy("i").agg(F.max("label").alias("label"))
    n = known.count()
    if n > max_rows:  # no more ids than rows are wanted, chosen by the same hash everywhere
        known = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "binary"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("i")).select("doc_id", "label", "text", F.xxhash64("doc_id", "text").alias("u"))
    # Texts stay where they are; only statistics come to the driver.
    measured = rows.mapInArrow(_statistics_task, "doc_id long, label int, u long, x array<double>").dropDuplicates(["doc_id", "u"])
    got = measured.orderBy("u", "doc_id").limit(max_rows).toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(got.num_rows, len(STATISTICS))
    return fit(x, got["label"].to_numpy().astype(float), **options)


def score_documents(docs: DataFrame, model: FlatTrees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row.

    A null text counts as empty and is scored like one; a null id stays null and is not
    held out; repeated rows get equal scores; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = columns_or_null(docs, doc_id=(id_col, "long"), text=(text_col, "binary"))
    scored = rows.mapInArrow(lambda batches: _score_task(batches, model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fold_of(doc_id: int) -> int:
    """The fold of an id, as the contract works it out."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
