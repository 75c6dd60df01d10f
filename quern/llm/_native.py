"""Word arrays and bindings for operators that stay in DataFrame functions.

Higher-order functions are evaluated row by row, and the optimizer may copy the
definition of a column into a lambda that uses it, where it would run once for each
element. ``let`` binds a value to a lambda's variable instead, which no rule undoes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of the two kinds of words the contracts name (fixed values).
SPACE_RUN = r"[\x20\x09-\x0D]+"
PLAIN_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all other letters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def plain_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PLAIN_RUN), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int, tag: int = 0) -> Column:
    """Hash of every run of ``k`` word hashes, in order; fewer words: an empty array."""
    def body(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.lit(tag), *[h[i + j] for j in range(k)]))
        return F.when(F.size(h) >= k, runs).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, body)


def covered(spans: Column) -> Column:
    """Length of the union of ``(start, length)`` structs sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct(
            (acc["sum"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], s["start"]))).alias("sum"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(spans, zero, step, lambda acc: acc["sum"])
