import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import _tokens
from quern.llm._tokens import TextEncoder, encoder
from quern.llm.packing import SumOfSquares, pack_documents, padded_length, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abAB 09'\t\n\r\x0b\x1c\x1f\x85\xa0é½²ß१日_.!?-s"), st.characters(codec="utf-8")), max_size=60))
def test_cached_pieces_equal_the_library(text):
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)


def test_latin_texts_are_split_by_classes_spelt_out():
    """Every character of Latin-1, in runs, between letters and before spaces; no such text takes the slower pattern."""
    for a in map(chr, range(256)):
        for text in (f"{a}{a}b {a}{a} ", f"x {a}é{a}1 {a}\n", f"'s{a}'ll {a}{a}\xa0{a}"):
            assert _tokens._is_latin(text) and _tokens.LATIN_PIECES.findall(text) == _tokens.PIECES.findall(text)
            assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == ids_of(text)
    assert not _tokens._is_latin("aœ") and not _tokens._is_latin("日")


def test_added_token_and_tiny_cache():
    enc = TextEncoder(PATH, limit=3)
    for text in ("x <|endoftext|> y", "a b c d e f g a b c", "", None):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids_of(text)


def test_level_choice_minimises_the_sum_of_squares():
    rng, ss = np.random.default_rng(0), SumOfSquares(16)
    counts = [0] * 17
    for size in rng.integers(1, 16, 400).tolist():
        def after(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return sum(x * x for x in c)

        options = [0] + [h for h in range(1, 17 - size) if counts[h]]
        level = ss.place(size)
        assert after(level) == min(map(after, options))
        if level:
            counts[level] -= 1
        if level + size < 16:
            counts[level + size] += 1


def check_pieces(found, rows, capacity, end_id=0):
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {}
    for key, text, *_ in rows:
        want.setdefault(key, []).append(array("I", ids_of(text) + [end_id]))
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, want[key]))
        if len(want[key]) == 1:
            ids, at = want[key][0], 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
                at += p["length"]
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity and all(p["sequence_tokens"] == at and p["padded_to"] == padded_length(at, capacity) for p in pieces)
    return by_sequence


@pytest.mark.parametrize("capacity", [8, 1024])
@pytest.mark.parametrize("extra", [False, True])
def test_every_id_in_one_piece(docs, hard_rows, capacity, extra):
    found = pack_documents(docs(hard_rows, extra), PATH, capacity).collect()
    windows = check_pieces(found, hard_rows, capacity)
    full = sum(sum(p["length"] for p in w) == capacity for w in windows.values())
    assert len(windows) - full <= 3  # one open window for each task at most


def test_sequences_hold_the_ids(docs, hard_rows):
    pieces = pack_documents(docs(hard_rows), PATH, 1024, with_ids=True)
    total = 0
    for s in sequences(pieces).collect():
        ids = np.frombuffer(s["ids"], "<u4")
        assert len(ids) == sum(s["piece_lengths"]) <= 1024
        total += len(ids)
    assert total == sum(len(ids_of(t)) + 1 for _, t, *_ in hard_rows)


def test_empty_table(docs):
    assert pack_documents(docs([]), PATH).count() == 0


def test_share_made_at_close_falls_with_the_partition(docs):
    rows = [(i, " ".join(f"word{(i * j) % 811}" for j in range(20 + i * 7919 % 400))) for i in range(1500)]

    def share(parts):
        found = {(r["sequence_id"], r["at_close"]) for r in pack_documents(docs(rows, parts=parts), PATH).collect()}
        return sum(c for _, c in found) / len(found)

    assert share(1) < share(8)
