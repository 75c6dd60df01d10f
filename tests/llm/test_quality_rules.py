import re

import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


@pytest.mark.parametrize("extra", [False, True])
def test_measures_equal_brute_force(docs, hard_rows, extra):
    phrase = "a b c d e f g h "
    rows = hard_rows + [(20, phrase * 3 + "x " * 30), (21, "\n".join(["same line"] * 4 + ["", " ", "other"])), (22, phrase + "y z " + phrase), (23, "# $ % | < > & * " * 9), (24, "x " * 40)]
    found = q.apply_rules(docs(rows, extra)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr((k, *brute(t))) for k, t, *_ in rows)


def long_text(i, symbols=False):
    return " ".join(f"w{i}n{j}" + ("#" if symbols else "") for j in range(40))


def test_bad_hosts_lose_soft_failures_only(docs):
    rows = [(i, long_text(i, i % 10 != 0), "bad") for i in range(60)] + [(100 + i, long_text(i, i % 10 == 0), "good") for i in range(600)] + [(2000, long_text(1, True), None)]
    table = docs(rows)
    kept = {r["doc_id"]: r["kept"] for r in q.apply_rules(table).collect()}
    assert [i for i in range(60) if kept[i]] == [0, 10, 20, 30, 40, 50]
    assert all(kept[100 + i] for i in range(600))
    salted = {r["doc_id"]: r["kept"] for r in q.apply_rules(table, broadcast_hosts=0).collect()}
    assert salted == kept
    left = q.keep_passed(table.withColumn("d", F.lit(1)).withColumn("t", F.lit(2)))
    assert left.columns[-2:] == ["d", "t"] and {r["doc_id"] for r in left.collect()} == {k for k, v in kept.items() if v}


def test_one_host_failure_is_shrunk(docs):
    rows = [(i, long_text(i, i // 40 == i % 20), f"h{i % 40}") for i in range(800)] + [(9000, long_text(9000, True), "new")]
    judged = q.apply_rules(docs(rows))
    assert judged.where("doc_id = 9000").first()["kept"]


def test_empty_table(docs):
    assert q.apply_rules(docs([])).count() == 0 and q.keep_passed(docs([])).count() == 0


def test_no_python_in_the_plan(docs, hard_rows):
    plan = q.measure(docs(hard_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_hosts_in_the_priors_upper_tail_are_bad(docs):
    rates = [1, 1, 2, 1, 2, 1, 1, 2, 1, 2, 1, 2, 1, 1, 2, 1, 2, 1, 1, 12]  # failures in 40
    rows = [(100 * h + i, long_text(100 * h + i, i < r), f"h{h}") for h, r in enumerate(rates) for i in range(40)]
    judged = {r["doc_id"]: r["kept"] for r in q.apply_rules(docs(rows)).collect()}
    assert [k for k, v in sorted(judged.items()) if not v] == [1900 + i for i in range(12)]


def test_hosts_that_differ_by_chance_are_not_bad(docs):
    rows = [(100 * h + i, long_text(100 * h + i, i < 4 + h % 3), f"h{h}") for h in range(12) for i in range(40)]
    assert q.apply_rules(docs(rows)).where("not kept").count() == 0


def test_registered_host_verdicts_change_rows(spark, sf):
    from quern.llm import queries

    rows = queries.op4_host_beta_rules_tables_apart(spark, sf).where("not kept and not base_failed").count()
    assert rows > 0


def test_stage_keeps_rows_as_they_are(docs):
    rows = [(None, long_text(1)), (None, None), (1, long_text(2), None), (1, long_text(3)), (1, long_text(3)), (2, "")]
    left = q.keep_passed(docs(rows, extra=True)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(0, long_text(1)), (1, long_text(2)), (1, long_text(3)), (1, long_text(3))])
