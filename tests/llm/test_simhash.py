import numpy as np
import pytest
import xxhash

from quern.llm import simhash as s
from quern.llm._components import components, local_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius=3):
    u = np.unique(np.array(prints, dtype=np.uint64))
    a, b = [], []
    for i in range(len(u)):
        near = np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= radius) + i + 1
        a += [i] * len(near)
        b += near.tolist()
    return u, local_components(len(u), np.array(a, dtype=int), np.array(b, dtype=int))


def clusters(rng, n, centres):
    x = np.repeat(rng.integers(0, 2**64, size=centres, dtype=np.uint64), -(-n // centres))[:n]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, size=n, dtype=np.uint64))
    return np.unique(x)


def test_spark_and_library_hash_alike(spark):
    text = "Ab cd ñé"
    assert spark.sql(f"select xxhash64('{text}') h").first()["h"] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("text", ["", " \n", "one", "Two words", "three Word text", "Ünï ABC déf ghi jkl " * 9, "a b c d e f g h i j k" * 50])
def test_fingerprint(text):
    assert s.simhash(text.encode()) == brute_print(text)


@pytest.mark.parametrize("n,centres", [(60, 4), (3000, 20), (9000, 2), (5000, 5000)])
def test_index_finds_all_links(n, centres):
    x = clusters(np.random.default_rng(n), n, centres)
    x = x[np.argsort(s.gray_rank(x))]
    assert (np.sort(s.gray_rank(x)) == s.gray_rank(x)).all()
    u, want = brute_components(x)
    got = s.GrayIndex(x).links(3)
    back = {v: i for i, v in enumerate(u.tolist())}
    at = np.array([back[v] for v in x.tolist()])
    assert len(set(got)) == len(set(want)) and len(set(zip(got.tolist(), want[at].tolist()))) == len(set(want))


@pytest.mark.parametrize("index_rows,pairs", [(32_768, 1_000_000), (64, 500)])
def test_every_print_passes_through_an_index(monkeypatch, index_rows, pairs):
    monkeypatch.setattr(s, "INDEX_ROWS", index_rows)
    monkeypatch.setattr(s, "SEARCH_PAIRS", pairs)
    rng = np.random.default_rng(11)
    x = clusters(rng, 1500, 60)
    keys = np.r_[np.repeat(np.arange(400), 3), np.full(300, 7)][: len(x)]
    seen, make = [], s.GrayIndex.__init__

    def noted(self, prints, groups=None, fan_out=s.FAN_OUT):
        seen.append(len(prints))
        make(self, prints, groups, fan_out)

    monkeypatch.setattr(s.GrayIndex, "__init__", noted)
    order = rng.permutation(len(x))
    a, b = s.forest(keys[order], x[order], 3)
    assert sum(seen) == len(x)
    pairs = [(i, j) for k in np.unique(keys) for i in np.flatnonzero(keys == k) for j in np.flatnonzero(keys == k) if i < j and bin(int(x[i] ^ x[j])).count("1") <= 3]
    want = local_components(len(x), *(np.array(p) for p in zip(*pairs)))
    place = {int(v): i for i, v in enumerate(x)}
    got = local_components(len(x), np.array([place[int(v)] for v in a]), np.array([place[int(v)] for v in b]))
    assert (got == want).all() and len(set(want)) < len(x)


@pytest.mark.parametrize("group_rows", [20_000, 40])
def test_links_over_tables(spark, group_rows):
    x = clusters(np.random.default_rng(7), 4000, 3)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    links = s.near_links(df, len(x), 3, group_rows)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    u, want = brute_components(x)
    names = [roots.get(int(v), int(v)) for v in u.view(np.int64)]
    assert len(set(zip(names, want.tolist()))) == len(set(names)) == len(set(want.tolist()))


def test_masks_cover_every_near_pair():
    rng = np.random.default_rng(1)
    for rows in (1000, 10**9, 10**12):
        masks = s.block_masks(3, rows)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("extra", [False, True])
def test_documents(docs, hard_rows, extra):
    base = " ".join(f"word{i}" for i in range(400))
    rows = hard_rows + [(50 + i, base + (f" tail{i}" if i % 2 else "")) for i in range(20)] + [(90, base.upper())]
    found = s.near_duplicates(docs(rows, extra)).collect()
    assert len(found) == len(rows)
    prints = [brute_print(t) for _, t, *_ in rows]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fp"] % 2**64) for r in found) == sorted((-1 if k is None else k, p) for (k, *_), p in zip(rows, prints))
    u, label = brute_components(prints)
    group = {int(v): g for v, g in zip(u, label)}
    least = {}
    for (k, *_), p in zip(rows, prints):
        if k is not None:
            least[group[p]] = min(k, least.get(group[p], k))
    assert all(r["component_id"] == least.get(group[r["fp"] % 2**64]) for r in found)


def test_keep_one_each(docs, hard_rows):
    base = " ".join(f"word{i}" for i in range(400))
    rows = hard_rows + [(50 + i, base) for i in range(30)]
    table = docs(rows, extra=True)
    left = s.keep_one_each(table)
    ids = [r["doc_id"] for r in left.collect()]
    assert {r["doc_id"]: r["text"] for r in left.collect()}[50] == base
    assert left.columns == table.columns and ids.count(50) == 1 and not set(ids) & set(range(51, 80)) and ids.count(1) == 1 and 2 not in ids and 10 not in ids


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("group_rows,hot_texts", [(20_000, 5), (3, 2)])
def test_similar_texts_are_linked(docs, monkeypatch, group_rows, hot_texts):
    monkeypatch.setattr(s, "HOT_TEXTS", hot_texts)
    rng = np.random.default_rng(3)
    rows = []
    for group in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 50 + 30 * group)]
        for copy in range(6):
            words = list(base)
            for at in rng.integers(0, len(words), copy * (1 + group // 4)):
                words[at] = f"new{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    n, texts = len(rows), [t for _, t in rows]
    near = [(i, j) for i in range(n) for j in range(i + 1, n) if jaccard(texts[i], texts[j]) >= 0.8]
    far = [1 for i, j in near if bin(s.simhash(texts[i].encode(), 3) ^ s.simhash(texts[j].encode(), 3)).count("1") > 3]
    assert far  # which the fingerprints of three words miss
    want = local_components(n, *(np.array(x) for x in zip(*near)))
    found = {r["doc_id"]: r["stands"]["doc_id"] for r in s.similar_components(docs(rows), group_rows=group_rows).collect()}
    assert [found[i] for i in range(n)] == want.tolist()


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(600)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(601)} == {0} and roots[1001] == roots[1000] == 1000


def test_empty(docs):
    assert s.near_duplicates(docs([])).count() == 0
    assert s.keep_one_each(docs([])).count() == 0


def test_repeated_ids_with_other_texts_are_other_documents(docs):
    one, two, three = (" ".join(f"{n}x{i}" for i in range(40)) for n in "abc")
    rows = [(1, one), (1, two), (2, two), (None, three), (None, three), (None, one), (3, None), (4, "")]
    left = s.keep_one_each(docs(rows, extra=True)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, one), (1, two), (0, three), (3, "")])


def test_hot_texts_are_spread(docs):
    rows = [(i, "one text of a third of all rows") for i in range(300)] + [(1000 + i, f"text number {i} with words of its own {i * i}") for i in range(600)]
    found = {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs(rows)).collect()}
    assert len(found) == 900 and {found[i] for i in range(300)} == {0}
    assert s.keep_one_each(docs(rows)).where("doc_id < 300").count() == 1


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, size=n, dtype=np.uint64) for n in (0, 1, 60, 64, 65, 500, 1300)]
    sets += [np.unique(np.r_[x[: int(0.9 * len(x))], rng.integers(0, 2**63, size=int(0.15 * len(x)), dtype=np.uint64)]) for x in sets]
    sets = sorted((np.unique(x) for x in sets), key=len)
    text, sizes = np.repeat(np.arange(len(sets)), list(map(len, sets))), np.array(list(map(len, sets)))
    bits = s._parity_bitmaps(text, np.concatenate(sets), sizes)
    assert all(len(b) * 8 >= max(64, n) and len(b) * 8 < max(65, 2 * n) for b, n in zip(bits, sizes))
    maps = s._Bitmaps(bits)
    for i in range(len(sets)):
        others = np.arange(i, len(sets))
        bound = maps.least_differences(i, others)
        truth = [len(np.setxor1d(sets[i], sets[j])) for j in others]
        assert (bound <= truth).all() and bound[0] == 0
    far = maps.least_differences(len(sets) - 2, np.array([len(sets) - 1]))[0]
    assert far > 0


def test_texts_that_share_a_passage_make_no_pairs(docs, monkeypatch):
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 90))) for i in range(150)]
    made, cross = [], s._cross_task

    def noted(batches, similarity):
        for b in cross(batches, similarity):
            made.append(b.num_rows)
            yield b

    texts = [t.encode() for _, t in rows]
    text, grams = s.text_grams(texts, 5)
    assert len(np.unique(text)) == 150
    order = np.lexsort((grams, text))
    bits = s._parity_bitmaps(text[order], grams[order], np.bincount(text))
    shared = s.text_grams([passage.encode()], 5)[1][:8]
    import pyarrow as pa

    rows_of = [(int(g >> np.uint64(1)), i, 146, 3, i) for g in shared for i in range(150)]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*rows_of)), pa.array([bits[r[1]] for r in rows_of], pa.binary())], names=["key", "node", "n", "at", "root", "bits"])
    list(noted([batch], 0.8))
    assert sum(made) == 0 and s.keep_one_each(docs(rows)).count() == 150


def test_checked_pairs_come_back_as_a_forest():
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(60)) + f" end{k}" for k in range(30)] + ["something else altogether " * 20]
    pairs = [(i, j, texts[i].encode(), texts[j].encode()) for i in range(31) for j in range(i + 1, 31)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["a", "b", "text_a", "text_b"]) for part in (pairs[:200], pairs[200:])]
    found = [(r["a"], r["b"]) for out in s._check_task(batches, 5, 0.8) for r in out.to_pylist()]
    labels = local_components(31, *(np.array(x) for x in zip(*found)))
    assert len(found) == 29 and set(labels[:30]) == {0} and labels[30] == 30
