import zlib
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from quern.llm import sharding
from quern.llm.sharding import GROUP_SHARE, ROW_BYTES, _GROUP, _digests, assign_shards, shard_ends, write_shards


def check(found, rows, shards):
    assert len(found) == len(rows)
    want = sorted((-1 if k is None else k, len((t or "").encode()) + ROW_BYTES, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots, sizes = {}, dict.fromkeys(range(shards), 0)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(s - mean) <= 2 * max([GROUP_SHARE * mean, *(r["size"] for r in found)]) for s in sizes.values())


def brute_ends(rows, shards):
    """The rule over all keys at once, by trying every edge."""
    sizes = {}
    for key, size in rows:
        sizes[key] = sizes.get(key, 0) + size
    keys, total = sorted(sizes), sum(sizes.values())
    slack = max(GROUP_SHARE * total / shards, max(s for _, s in rows))
    out = []
    for i in range(1, shards):
        target, edges, upto = total * i / shards, [(0, keys[0])], 0
        for k, following in zip(keys, [*keys[1:], (1 << 63) - 1]):
            upto += sizes[k]
            edges.append((upto, following))
        best = min(edges, key=lambda e: (abs(e[0] - target), e[0]))
        at = edges.index(best)
        if 0 < at < len(keys) and keys[at - 1] // _GROUP == keys[at] // _GROUP:
            group = [j for j, k in enumerate(keys) if k // _GROUP == keys[at] // _GROUP]
            sides = [edges[group[0]], edges[group[-1] + 1]]
            if sides[1][0] - sides[0][0] <= slack:
                best = min(sides, key=lambda e: (abs(e[0] - target), e[0]))
        out.append(best[1])
    return sorted(out)


@pytest.mark.parametrize("extra", [False, True])
def test_hard_rows(docs, hard_rows, extra):
    check(assign_shards(docs(hard_rows, extra), 3).collect(), hard_rows, 3)


@pytest.mark.parametrize("rows, shards, leaf", [
    ([(i, f"text number {i} " * (i % 7)) for i in range(800)], 8, 2000),
    ([(i, f"text number {i} " * (i % 7)) for i in range(800)], 8, 5),
    ([(i, "hot text of a copy" if i % 3 else f"text {i} " * (i % 7)) for i in range(1500)], 8, 7),
    ([(i, f"text {i % 50} " * 10) for i in range(1000)], 4, 3),
    ([(i, f"text {i % 300} " * (i % 300)) for i in range(700)], 40, 4),
    ([(i, "same") for i in range(500)], 6, 10),
])
def test_ends_equal_brute_force(docs, monkeypatch, rows, shards, leaf):
    monkeypatch.setattr(sharding, "LEAF_ROWS", leaf)
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 2)
    monkeypatch.setattr(sharding, "KEYS_PER_DIVISION", 6)
    keyed = _digests(docs(rows), "doc_id", "text", F.col("doc_id"))
    all_rows = [(r["key"], r["size"]) for r in keyed.collect()]
    want = brute_ends(all_rows, shards)
    got = shard_ends(keyed, shards)
    place = [bisect_right(want, k) for k, _ in all_rows]
    assert [bisect_right(got, k) for k, _ in all_rows] == place


def test_one_text_in_most_rows_is_divided(docs, monkeypatch):
    monkeypatch.setattr(sharding, "LEAF_ROWS", 50)
    rows = [(i, "hot text of a copy" if i % 3 else f"text number {i} " * (i % 7)) for i in range(6000)]
    check(assign_shards(docs(rows), 8).collect(), rows, 8)


def test_equal_texts_stand_together(docs):
    rows = [(i, f"text {i % 200} " * 10) for i in range(400)] + [(1000 + i, f"long text {i} " * 400) for i in range(20)]
    found = assign_shards(docs(rows), 4).collect()
    shards = {}
    for r in found:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())  # pairs are smaller than the largest row


def test_empty_table(docs, tmp_path):
    assert assign_shards(docs([]), 4).count() == 0


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    rows = [(i, f"text {i} " * (i % 9 + 1)) for i in range(300)] + [(None, "null id"), (None, "null id"), (7, "id twice"), (7, "id twice")]
    table = docs(rows, extra=True)
    placed = write_shards(table, str(tmp_path / "out"), 3).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() == 3 and set(back.columns) == {*table.columns, "slot"}
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((k or -1, t) for k, t in rows)
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in placed)
