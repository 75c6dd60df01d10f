"""Whole-text tokenisation with a bounded piece cache.

``tokenizers`` runs byte-pair merges piece by piece: the pre-tokenizer splits a
text, and each piece is merged on its own. Ids of a piece therefore do not
depend on its neighbours, and caching them per piece gives exactly the ids of
a whole-text ``encode`` at a fraction of its cost. Texts that hold the literal
form of an added token are passed to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

#: The byte-level pre-tokenizer's pattern (public GPT-2 pattern, a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same pattern for texts of Latin-1 alone, its classes spelt out: the standard library splits them faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
ID_BYTES = 4


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Bounded(dict):
    """A cache in two generations: a full one becomes the old one, and what is
    still asked for moves back. Holds ``2 * limit`` entries at most."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.old.get(key)
        if packed is None:
            packed = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = packed
        return packed


def _byte_letters() -> dict[int, str]:
    """Letter for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()


class _Pieces(_Bounded):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer, limit: int):
        super().__init__(limit)
        self.merge = tokenizer.model.tokenize

    def make(self, piece: str) -> bytes:
        return pack_ids([t.id for t in self.merge(piece.encode().decode("latin-1").translate(_LETTERS))])


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _by_pieces(tokenizer: Tokenizer) -> bool:
    """Whether ids of a text are those of its pieces under ``PIECES``, joined."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")


class TextEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``limit`` bounds each of the two generations of the piece cache, and so the memory.
    """

    def __init__(self, path: str, limit: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self.tokenizer, limit) if _by_pieces(self.tokenizer) else None

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as packed little-endian uint32; null counts as empty."""
        if not text:
            return b""
        if self.pieces is None or any(token in text for token in self.added):
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pattern = LATIN_PIECES if _is_latin(text) else PIECES
        return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per process and vocabulary, so that tasks share its caches."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
