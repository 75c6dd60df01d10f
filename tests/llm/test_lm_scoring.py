import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import lm_scoring as lm


def brute(rows):
    texts = [(t or "").encode().lower().split() for _, t, *_ in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    n, out = sum(one.values()), []
    for (key, *_), t in zip(rows, texts):
        own1, own2, others = Counter(t), Counter(zip(t, t[1:])), n - len(t)
        total, kinds = 0.0, [0, 0, 0]
        for i, w in enumerate(t):
            pair = (t[i - 1], w) if i else None
            both = two[pair] - own2[pair] if pair else 0
            alone = one[w] - own1[w]
            back = math.log(0.4) if pair else 0.0
            if both:
                kinds[0] += 1
                total += math.log(both / (one[t[i - 1]] - own1[t[i - 1]]))
            elif alone:
                kinds[1] += 1
                total += back + math.log(alone / max(others, 1))
            else:
                kinds[2] += 1
                total += back - math.log(others + 1)
        out.append((key, len(t), *kinds, round(total / len(t), 6) if t else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("extra,text_bytes", [(False, 4_000_000), (True, 300)])
def test_equals_brute_force(docs, hard_rows, monkeypatch, extra, text_bytes):
    monkeypatch.setattr(lm, "TEXT_BYTES", text_bytes)
    rng = np.random.default_rng(0)
    rows = [r for r in hard_rows if r[0] != 6] + [(100 + i, " ".join(f"W{x}" for x in rng.zipf(1.3, 30) % 40)) for i in range(60)]
    found = lm.score_documents(docs(rows, extra), order=2).collect()
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_pairs"], r["n_singles"], r["n_unseen"], None if r["score"] is None else round(r["score"], 6))) for r in found)
    assert got == brute(rows)


def test_counts_are_of_ngrams_in_two_documents_or_more(docs):
    counts = lm.ngram_counts(docs([(1, "a b a b"), (2, "b a"), (3, "c c c")]), order=2).collect()
    assert sorted((r["k"], r["c"]) for r in counts) == [(1, 3), (1, 3), (2, 2)]


def test_a_very_frequent_word_is_spread(docs):
    rows = [(i, f"the the the w{i % 7}") for i in range(400)]
    got = {(r["doc_id"], r["n_triples"], round(r["score"], 6)) for r in lm.score_documents(docs(rows)).collect()}
    want = {r["doc_id"]: r for r in lm.score_documents(docs(rows, parts=1)).collect()}
    assert len(got) == 400 and all(n == want[k]["n_triples"] and s == round(want[k]["score"], 6) for k, n, s in got)


def test_only_document_and_empty(docs):
    r = lm.score_documents(docs([(1, "a b a")]), order=2).first()
    assert (r["n_unseen"], r["n_words"]) == (3, 3) and r["score"] == pytest.approx(2 * math.log(0.4) / 3)
    assert lm.score_documents(docs([])).count() == 0


def test_order_three_equals_brute_force(docs):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 25) % 20)) for i in range(40)] + [(50, ""), (51, "w1"), (52, "w1 w2"), (53, "w1 never w2 w1")]
    texts = [t.encode().split() for _, t in rows]
    grams = [[Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for k in (1, 2, 3)] for t in texts]
    whole = [sum((g[k] for g in grams), Counter()) for k in range(3)]
    total, want = sum(map(len, texts)), {}
    for (key, _), t, own in zip(rows, texts, grams):
        value, kinds, others = 0.0, [0, 0, 0, 0], total - len(t)

        def count(g):
            return whole[len(g) - 1][g] - own[len(g) - 1][g]

        for i in range(len(t)):
            for step, k in enumerate((3, 2, 1)):
                g = tuple(t[i - k + 1 : i + 1]) if i >= k - 1 else None
                if g and count(g):
                    kinds[step] += 1
                    value += math.log(count(g) / (count(g[:-1]) if k > 1 else others))
                    break
                value += math.log(0.4) if g and k > 1 else 0.0
            else:
                kinds[3] += 1
                value -= math.log(others + 1)
        want[key] = (*kinds, pytest.approx(value / len(t)) if t else None)
    for parts in (1, 5):
        found = lm.score_documents(docs(rows, parts=parts), order=3).collect()
        assert len(found) == len(rows) and sum(r["n_triples"] for r in found) > 0
        for r in found:
            assert (r["n_triples"], r["n_pairs"], r["n_singles"], r["n_unseen"], r["score"]) == want[r["doc_id"]]


def test_slices_and_rounds_change_nothing(docs, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 25) % 20)) for i in range(60)] + [(70, ""), (71, None), (71, "w1 w2")]
    want = sorted(map(repr, lm.score_documents(docs(rows)).selectExpr("doc_id", "n_triples", "n_pairs", "round(score, 6) as score").collect()))
    monkeypatch.setattr(lm, "PARCEL_BYTES", 500)
    monkeypatch.setattr(lm, "SLICES", 2)
    got = sorted(map(repr, lm.score_documents(docs(rows)).selectExpr("doc_id", "n_triples", "n_pairs", "round(score, 6) as score").collect()))
    assert got == want and len(got) == len(rows)


def test_hashes_of_ngrams_are_those_of_spark(spark):
    words = np.array([1, 2**63 + 5, 3], dtype=np.uint64)
    found = lm.Places(words, np.array([3]), 3).hashes
    a, b, c = (int(x) for x in words.view(np.int64))
    pair, triple = spark.sql(f"select xxhash64(bigint('{b}'), bigint('{c}')), xxhash64(bigint('{a}'), bigint('{b}'), bigint('{c}'))").first()
    assert (pair, triple) == (int(found[2].view(np.int64)[2]), int(found[3].view(np.int64)[2]))


def test_places_are_named_by_first_places_and_own_counts():
    words = np.array([7, 9, 7, 9, 7, 5, 7, 9], dtype=np.uint64)  # of texts of five, none and three words
    places = lm.Places(words, np.array([5, 0, 3]), 2)
    named = [[(x >> 32, x & 0xFFFFFFFF) if x >= 0 else None for x in lm._named(places, k).tolist()] for k in (1, 2)]
    assert named[0] == [(0, 3), (1, 2), (0, 3), (1, 2), (0, 3), (5, 1), (0, 1), (1, 1)]
    assert named[1] == [None, (1, 2), (2, 2), (1, 2), (2, 2), None, (6, 1), (1, 1)]


def test_ngrams_that_agree_in_upper_bits_are_told_apart():
    rng = np.random.default_rng(1)
    for grams in (rng.integers(0, 9, 200), rng.integers(0, 2**63, 50)[rng.integers(0, 50, 300)], np.zeros(0)):
        grams = grams.astype(np.uint64)
        order, first = lm._together(grams)
        runs = [grams[order[i:j]] for i, j in zip(first, [*first[1:], len(grams)])]
        assert sorted(order.tolist()) == list(range(len(grams))) and len(runs) == len(set(grams.tolist()))
        assert all(len(set(r.tolist())) == 1 for r in runs) and all((np.diff(order[i:j]) > 0).all() for i, j in zip(first, [*first[1:], len(grams)]))


def test_words_of_all_lengths_have_hashes_of_their_own():
    words = [b"x" * n for n in range(1, 200)] + [b"x" * 70 + b"y", b"a\0", b"a", b"\0", b"\0\0", b"abcdefgh", b"abcdefgh\0", "ñ".encode()]
    hashes, sizes = lm._word_hashes([b"\t" + b" \n".join(words) + b" ", b"", b"  ", b" ".join(words).upper(), b"X\x0bx\x0c\xa0"])
    n = len(words)
    assert sizes.tolist() == [n, 0, 0, n, 3] and len(set(hashes[:n].tolist())) == n
    assert hashes[:n].tolist() == hashes[n : 2 * n].tolist() and hashes[-3] == hashes[-2] == hashes[0]
    assert lm._word_hashes([])[0].tolist() == [] and lm._word_hashes([b""])[1].tolist() == [0]


def test_places_are_joined_by_keys_of_64_bits(docs, spark, monkeypatch):
    plans = []
    scored = lm._scored
    monkeypatch.setattr(lm, "_scored", lambda *a: plans.append(scored(*a)) or plans[-1])
    lm.score_documents(docs([(1, "a b c"), (2, "a b c")])).collect()
    assert {dict(p.dtypes)["doc_id"] for p in plans} == {"bigint"}
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join LeftOuter" in line and "first" in line]
    assert len(joins) == 3 and not any(" h#" in line for line in joins)


def test_a_parcel_without_long_ngrams():
    """Texts of fewer words than the n-grams, or none, in a parcel or a slice of their own."""
    for words, ends in (([], [0, 0]), ([5, 6], [0, 1, 2])):
        texts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.int64()))
        batch = pa.RecordBatch.from_arrays([pa.array([3] * len(texts), pa.int32()), texts], names=["slot", "words"])
        for piece in range(2):
            assert sum(b.num_rows for b in lm._count_task([batch], 3, piece, 2)) == 0


def test_places_of_a_parcel_by_brute_force():
    """First place and own count of every n-gram, and whether one text alone has it."""
    rng = np.random.default_rng(5)
    sizes = np.array([0, 3, 40, 1, 0, 60, 2])
    words = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes).tolist()
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array([9] * len(sizes), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64)))], names=["slot", "words"])
    for k in (1, 2, 3):
        grams = [tuple(words[i - k + 1 : i + 1].tolist()) if i >= k - 1 and text[i - k + 1] == text[i] else None for i in range(len(words))]
        want = [-1 if g is None else (grams.index(g) << 32) | sum(h == g and t == text[i] for h, t in zip(grams, text)) for i, g in enumerate(grams)]
        assert lm._named(lm.Places(words, sizes, k), k).tolist() == want
        held = {g: [i for i, h in enumerate(grams) if h == g] for g in grams if g is not None}
        alone = {at[0]: (len({text[i] for i in at}) == 1, len(at)) for at in held.values()}
        found = [r for p in range(2) for b in lm._count_task([batch], k, p, 2) for r in b.to_pylist()]
        assert {r["place"] & ((1 << 32) - 1): (r["place"] < 0, r["m"]) for r in found} == alone and len(found) == len(alone)
        assert {(r["place"] & ((1 << 63) - 1)) >> 32 for r in found} == {9}


def test_runs_of_hashes_hold_the_rows_that_are_counted(docs, spark):
    """Each task has a range of hashes, in order, and exploded runs are the n-grams of the parcel; no n-gram is a row of a shuffle."""
    rng = np.random.default_rng(3)
    sizes = np.array([70_000, 0, 9, 30_000])
    words = rng.integers(-(2**63), 2**63 - 1, 40_000)[rng.integers(0, 40_000, sizes.sum())]
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array([2**31 - 1] * len(sizes), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(words))], names=["slot", "words"])
    tasks = np.array([9, 4, 7], dtype=np.int32)
    for k in (1, 2):
        want = {(r["h"], r["place"], r["m"]) for b in lm._count_task([batch], k, 1, 2) for r in b.to_pylist()}
        runs = [r for b in lm._run_task([batch], k, 1, 2, tasks) for r in b.to_pylist()]
        got = [(h, (r["slot"] << 32 | f & (2**31 - 1)) - (2**63 if f < 0 else 0), m) for r in runs for h, f, m in zip(r["h"], r["first"], r["m"], strict=True)]
        assert len(want) == len(got) > 1_000 and set(got) == want
        of = {t: [h % 2**64 for r in runs if r["task"] == t for h in r["h"]] for t in tasks.tolist()}
        assert max(of[9]) < min(of[4]) and max(of[4]) < min(of[7])
    assert list(lm._run_task([batch.slice(1, 1)], 2, 0, 1, tasks)) == []
    lm.prepare(spark)
    hashed, slots, size = lm._hashed(docs([(1, "a b c"), (2, "a b c")]), "doc_id", "text")
    for exploded in lm._exploded(hashed, lm._names(spark, slots), size, 2):
        plan = exploded._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert [i for i, x in enumerate(plan) if "Generate posexplode" in x] < [i for i, x in enumerate(plan) if "Repartition" in x]
        assert sorted(r["one"] & (lm._ONE - 1) for r in exploded.collect()) in ([1, 1, 1, 1], [2, 2])


def test_hashes_of_words_are_read_from_lists_and_from_bytes():
    texts = [[], [5, -6], [], [7], [2**63 - 1, 0, 1], []]
    both = [pa.array(texts, pa.list_(pa.int64())), pa.array([np.array(t, dtype=np.int64).tobytes() for t in texts], pa.binary())]
    for i, j in ((0, 6), (1, 5), (2, 3), (3, 5), (5, 6), (2, 2)):
        for column in both:
            words, sizes = lm._numbers(column.slice(i, j - i))
            assert words.view(np.int64).tolist() == sum(texts[i:j], []) and sizes.tolist() == [len(t) for t in texts[i:j]]


def test_counts_are_packed_by_parcels_and_joined_by_runs_of_places():
    """Every count comes back at its first place, whatever tasks and files it went through; no n-gram is a row of a table."""
    rng = np.random.default_rng(4)
    place = np.concatenate([(s << 32) + rng.permutation(5_000)[:n] for s, n in ((3, 900), (2**31 - 1, 40), (0, 1))])
    want = dict(zip(place.tolist(), rng.integers(2, 2**39, len(place)).tolist()))
    shuffled, packed = rng.permutation(place), []
    for part in (shuffled[:500], shuffled[500:], shuffled[:0]):
        batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array([want[p] for p in x.tolist()], pa.int64())], names=["place", "c"]) for x in (part[:7], part[7:])]
        packed += list(lm._pack_task(batches))
    assert list(lm._pack_task([])) == [] and sum(b.num_rows for b in packed) <= 6
    rows = [r for b in lm._block_task(packed, 8) for r in b.to_pylist()]
    assert all(len(r["c"]) == 8 and r["first"] % 8 == 0 and any(r["c"]) for r in rows) and len({(r["slot"], r["first"]) for r in rows}) == len(rows)
    assert {(r["slot"] << 32) + r["first"] + i: c for r in rows for i, c in enumerate(r["c"]) if c} == want


def test_documents_longer_than_a_run_of_places(docs, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 300) % 200)) for i in range(12)]
    want = sorted(map(repr, lm.score_documents(docs(rows)).selectExpr("doc_id", "n_triples", "n_pairs", "n_singles", "n_unseen", "round(score, 6)").collect()))
    monkeypatch.setattr(lm, "_PLACES", 16)
    got = sorted(map(repr, lm.score_documents(docs(rows)).selectExpr("doc_id", "n_triples", "n_pairs", "n_singles", "n_unseen", "round(score, 6)").collect()))
    assert got == want and len(got) == 12
