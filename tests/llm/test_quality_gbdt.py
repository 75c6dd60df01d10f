import zlib

import numpy as np
import pytest

from quern.llm import quality_gbdt as q


def good(i):
    rng = np.random.default_rng(i)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(rng.integers(30, 90))).capitalize() + "."


def bad(i):
    return f"BUY{i}!! " * (20 + i % 9)


def test_flat_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = q.fit(x, y, trees=40)
    z = rng.normal(size=(500, 5))

    def walk(row):
        total = model.bias
        for f, c, v in zip(model.features, model.cuts, model.leaves):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - len(f)]
        return total

    assert np.allclose(model.margin(z), [walk(r) for r in z])
    truth = (z[:, 0] > 0.3) ^ (z[:, 2] < -0.5)
    assert ((model.score(z) > 0.5) == truth).mean() > 0.95


def brute_fit(x, y, trees, depth, bins, rate, ridge, least_weight):
    """The same boosting by trying every cut of every statistic on the rows themselves."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    margin, out = np.full(len(y), np.log(share / (1 - share))), []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                return -rate * g[rows].sum() / (h[rows].sum() + ridge)
            best = (1e-9, None, np.inf)
            for j, cuts in enumerate(edges):
                for c in cuts:
                    left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if h[left].sum() >= least_weight and h[right].sum() >= least_weight:
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + ridge) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, j, c)
            if best[1] is None:
                return (0, np.inf, grow(rows, level + 1), 0.0)
            return (best[1], best[2], grow(rows[x[rows, best[1]] <= best[2]], level + 1), grow(rows[x[rows, best[1]] > best[2]], level + 1))

        def value(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        tree = grow(np.arange(len(y)), 0)
        out.append(tree)
        margin = margin + np.array([value(tree, r) for r in x])
    return margin


def test_histogram_fit_equals_brute_force():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=150)) > 0.4).astype(float)
    options = {"trees": 3, "depth": 3, "bins": 16, "rate": 0.3, "ridge": 1.0, "least_weight": 2.0}
    assert np.allclose(q.fit(x, y, **options).margin(x), brute_fit(x, y, **options))


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_one_class_or_none_gives_a_constant(y):
    model = q.fit(np.zeros((len(y), len(q.STATISTICS))), np.array(y))
    score = model.score(np.zeros((3, len(q.STATISTICS))))
    assert len(set(score)) == 1 and 0 < score[0] < 1


def test_statistics_use_the_whole_text():
    a, b = b"plain words here " * 50_000, b"plain words here " * 50_000 + b"### " * 9
    assert (q.statistics(a) != q.statistics(b)).any() and np.isfinite(q.statistics(b)).all()
    assert not q.statistics(b"").any() and np.isfinite(q.statistics(b"\n \n")).all()


def test_scores_and_folds(spark, docs, hard_rows):
    rows = [(100 + i, good(i) if i % 2 else bad(i)) for i in range(400)]
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (100, 0, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(rows + hard_rows, extra=True)
    found = q.score_documents(table, q.train(table, labels)).collect()
    assert len(found) == len(rows) + len(hard_rows)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 100 and r["held_out"]]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95


def test_held_out_labels_are_not_learned(spark, docs):
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(200)]
    labels = [(i, i % 2, 0) for i in range(200)]
    flipped = [(i, 1 - v if q.fold_of(i) == 2 else v, t) for i, v, t in labels]
    table = docs(rows)
    a, b = (q.train(table, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.leaves, b.leaves) and np.array_equal(a.cuts, b.cuts)


def test_bound_and_empty(spark, docs):
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = q.train(docs(rows), labels, max_rows=50)
    again = q.train(docs(rows, parts=7), labels.repartition(5), max_rows=50)  # the sample does not depend on partitions
    assert np.array_equal(model.leaves, again.leaves) and np.array_equal(model.cuts, again.cuts)
    assert q.score_documents(docs([]), model).count() == 0
    assert q.train(docs([]), labels).score(np.zeros((1, len(q.STATISTICS))))[0] == pytest.approx(0.5)


def test_held_out_accuracy_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = q.score_documents(docs, q.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.9
