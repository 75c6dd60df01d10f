import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import rans

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31), max_size=400), st.integers(1, 40))
def test_round_trip(ids, distinct):
    data = np.array([i % distinct * 1237 for i in ids], dtype="<u4")
    got = rans.Segment(rans.encode_segment([5, None], [len(ids), 0], data.tobytes()))
    assert np.array_equal(got.ids(), data) and got.doc_ids == [5, None] and got.lengths.tolist() == [len(ids), 0]


def large(n=1_300_000):
    return (np.random.default_rng(3).zipf(1.2, n) % 50_000).astype("<u4")


def test_runs_decode_alone_and_compress():
    ids = large()
    data = rans.encode_segment([1], [len(ids)], ids.tobytes())
    segment = rans.Segment(data)
    assert len(segment.runs) > 4 and len(data) < 0.5 * ids.nbytes
    at = np.cumsum([0] + [r[0] for r in segment.runs])
    for i in reversed(range(len(segment.runs))):
        assert np.array_equal(segment.decode(i), ids[at[i] : at[i + 1]])


def test_frequencies_fill_the_scale():
    for ids in (large(1000), np.zeros(5, "<u4"), np.arange(3000, dtype="<u4")):
        symbols, f = rans.frequencies(ids)
        assert f.sum() == 1 << rans.SCALE_BITS and f.min() >= 1 and symbols.tolist() == np.unique(ids).tolist()


def test_damage_is_found():
    ids = large(200_000)
    data = bytearray(rans.encode_segment([1], [len(ids)], ids.tobytes()))
    head = bytearray(data)
    head[30] ^= 1
    with pytest.raises(ValueError):
        rans.Segment(bytes(head))
    data[-3] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.Segment(bytes(data)).ids()


@pytest.mark.parametrize("segment_tokens", [rans.SEGMENT_TOKENS, 50])
def test_files_of_documents(spark, docs, hard_rows, tmp_path, segment_tokens):
    path = str(tmp_path / "files")
    rans.write_token_files(docs(hard_rows, extra=True), path, PATH, segment_tokens=segment_tokens)
    found = sorted(rans.read_token_index(spark, path).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(PATH), 0
    want = {}
    for k, t, *_ in hard_rows:
        ids = array("I", library.encode(t or "", add_special_tokens=False).ids + [0])
        want.setdefault(k, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r["doc_id"] for r in found] == sorted((k for k, *_ in hard_rows), key=lambda k: (k is not None, k))
    for r in found:
        assert r["start"] == at
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    assert not any(want.values())


def test_ranges_follow_the_input(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(rans, "RANGE_BYTES", 200)
    table = docs([(i, f"text {i} with a few words") for i in range(200)])
    rans.write_token_files(table, str(tmp_path / "files"), PATH)
    parts = table.sparkSession.read.parquet(str(tmp_path / "files")).select("part").distinct().count()
    assert parts > 4  # the session's number of partitions


def test_empty(docs):
    assert rans.round_trip(docs([]), PATH).count() == 0
