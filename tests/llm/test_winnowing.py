import re

import pytest
from pyspark.sql import functions as F

from quern.llm import winnowing as w
from quern.llm._native import word_hashes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for key, text in items:
        ws = words(text)
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows.setdefault((n, tuple(ws[i : i + n])), set()).add(key)
    out = []
    for key, text, *_ in rows:
        ws, hit, found = words(text), set(), set()
        for n in {n for n, _ in windows}:
            for i in range(len(ws) - n + 1):
                ids = windows.get((n, tuple(ws[i : i + n])))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        names = sorted(str(x) for x in found if x is not None)
        out.append((key, len(ws), len(hit), tuple(names), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(map(repr, out))


def passage(a, n):
    return " ".join(f"Tok{(a * 31 + i * i) % 97}ü" if i % 5 == 0 else f"tok{(a * 17 + i) % 89}" for i in range(n))


ITEMS = [(1, passage(1, 40)), (2, passage(2, 13)), (3, passage(3, 12)), (4, "Only Four short words!"), (5, "unique"), (6, ""), (7, None), (None, passage(8, 20)), (9, passage(1, 40)), (10, passage(2, 13))]


def rows_with_hits(hard_rows):
    filler = " ".join(f"filler{i}" for i in range(300))
    p = passage(1, 40)
    return hard_rows + [
        (30, f"{filler} {p}, {filler}"), (31, p.upper()), (32, " ".join(p.split()[5:18])), (33, " ".join(p.split()[5:17])), (34, f"x {passage(3, 12)} y"), (35, f"{passage(3, 11)}"),
        (36, "only-four;short words and more"), (37, f"{filler} unique"), (38, f"{passage(2, 13)} {passage(2, 13)}"), (39, f"{p} {p}"), (40, passage(8, 20)),
    ]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_equals_brute_force(spark, docs, hard_rows, broadcast_rows):
    rows = rows_with_hits(hard_rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = w.judge(docs(rows, extra=True), items, broadcast_rows=broadcast_rows).collect()
    got = sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])) for r in found)
    assert got == brute(rows, ITEMS)


def test_minima_are_window_minima(spark):
    df = spark.createDataFrame([([f"a{i}" for i in range(40)],), (["x"] * 12,), ([],)], "w array<string>")
    for length in (1, 2, 7, 13):
        k = (length + 1) // 2
        from quern.llm._native import gram_hashes

        for r in df.select(gram_hashes(word_hashes(F.col("w")), k, tag=length).alias("g"), w.minima(word_hashes(F.col("w")), length).alias("m")).collect():
            width = length - k + 1
            assert r["m"] == [min(r["g"][i : i + width]) for i in range(len(r["g"]) - width + 1)]


def test_fewer_fingerprints_than_grams(spark):
    df = spark.createDataFrame([([f"a{i * i % 1009}b{i}" for i in range(5000)],)], "w array<string>")
    n = df.select(F.size(F.array_distinct(w.minima(word_hashes(F.col("w")), 13))).alias("n")).first()["n"]
    assert n < 5000 * 0.35


def test_empty_tables(spark, docs, hard_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in w.judge(docs(hard_rows), none).collect())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert w.judge(docs([]), items).count() == 0 and w.keep_clean(docs([]), items).count() == 0


def test_keep_clean(spark, docs, hard_rows):
    rows = rows_with_hits(hard_rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = docs(rows, extra=True)
    left = w.keep_clean(table, items)
    assert left.columns == table.columns
    assert left.count() == sum("True" not in x for x in brute(rows, ITEMS))


def test_no_python_in_the_plan(spark, docs, hard_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = w.judge(docs(hard_rows), items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
