"""Names, paths and text forms as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Audio extensions, compound first (fixed values).
AUDIO_EXTENSIONS = (".mp3.wav", ".wav", ".mp3", ".m4a", ".ogg", ".flac")
_ANY_AUDIO = r"(?i)(\.mp3\.wav|\.wav|\.mp3|\.m4a|\.ogg|\.flac)$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@pandas_udf(T.StringType())
def _fold_unicode(s: pd.Series) -> pd.Series:
    def fold(x):
        if x is None:
            return None
        return " ".join(unicodedata.normalize("NFKC", x).replace("&amp;", "&").casefold().split())

    return s.map(fold)


def fold_text(x: Column | str) -> Column:
    """NFKC, ``&amp;`` to ``&``, case folded, white space collapsed and trimmed.

    Plain ASCII stays in the JVM; other texts go to Python in batches.
    """
    text = _col(x)
    plain = F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("&amp;"), F.lit("&"))), r"[\s\x1c-\x1f]+", " "))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(_fold_unicode(text))


def strip_audio_extension(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), _ANY_AUDIO, "")


def is_audio(x: Column | str) -> Column:
    return F.lower(_col(x)).rlike(r"\.(wav|mp3|flac|ogg|m4a)$")


def base_name(x: Column | str) -> Column:
    return F.substring_index(_col(x), "/", -1)


def top_folder(x: Column | str) -> Column:
    return F.substring_index(_col(x), "/", 1)


def depth_key(x: Column | str, depth: int) -> Column:
    """The first ``depth`` folders of a path; fewer if the path is not so deep."""
    parts = F.split(_col(x), "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.least(F.size(parts) - 1, F.lit(depth)), F.lit(1))), "/")


def extension(x: Column | str) -> Column:
    """Lower-case text behind the last dot of the name; empty without a dot."""
    name = base_name(x)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def leading_number(x: Column | str) -> Column:
    """Digits at the start of the name, as a number; null without."""
    return F.regexp_extract(base_name(x), r"^(\d+)", 1).try_cast("long")


def safe_relative_path(x: Column | str) -> Column:
    """Whether a member name stays inside its root: relative, no backslash or NUL, and no
    empty, ``.`` or ``..`` part."""
    path = _col(x)
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return path.isNotNull() & (path != "") & ~path.contains("\\") & ~path.contains("\x00") & ~bad


def transform_parameter(stem: Column | str, variant: Column | str) -> Column:
    """Suffix that names a transform's parameter, by the kind of transform; else empty."""
    out = F.lit("")
    for name, pattern in TRANSFORM_SUFFIXES.items():
        out = F.when(_col(variant) == name, F.regexp_extract(_col(stem), pattern, 1)).otherwise(out)
    return out


#: Suffixes of transformed files (fixed values).
TRANSFORM_SUFFIXES = {
    "aac": r"_(aac\d+)$",
    "mp3": r"_(mp3\d+)$",
    "ogg": r"_(ogg\d+)$",
    "eq": r"_(eq-(?:cut|boost)_(?:low|mid|high))$",
    "pitch_time": r"_(pt-ps[+-]\d+st-ts[\d.]+)$",
    "loudness": r"_(lnLUFS-?\d+)$",
    "gaussian": r"_(gn[\d.]+)$",
}


def percent_text(k: Column, n: Column) -> Column:
    """``12.3% (k/n)``; a dash for an empty group."""
    return F.when(n > 0, F.format_string("%.1f%% (%d/%d)", 100.0 * k / n, k, n)).otherwise("–")


def fixed_text(x: Column | str, digits: int) -> Column:
    """A number with so many digits; ``--`` for null."""
    return F.coalesce(F.format_string(f"%.{digits}f", _col(x)), F.lit("--"))


def looks_like_page(head: Column | str) -> Column:
    """Whether the first bytes of a file are those of a web page, not of its declared type."""
    return F.lower(F.ltrim(F.substring(_col(head), 1, 256))).rlike("^(<!doctype html|<html)")


def padded(size: Column | str, block: int = 512) -> Column:
    """A size filled up to whole blocks."""
    return (F.floor((_col(size) + (block - 1)) / block) * block).cast("long")


def record_end(data_offset: Column | str, size: Column | str) -> Column:
    """End of an archive record: behind its padded data."""
    return _col(data_offset) + padded(size)


def shard_stem(name: Column | str) -> Column:
    return F.regexp_replace(base_name(name), r"\.tar$", "")


def shard_url(base: str, repo: Column, revision: Column, name: Column) -> Column:
    """Address of a shard; each part of its name is escaped."""
    escaped = F.array_join(F.transform(F.split(name, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    return F.concat_ws("/", F.lit(base.rstrip("/")), repo, F.lit("resolve"), revision, escaped)


def report_path(model: Column, name: str = "leak_report") -> Column:
    """Where a model's report lies: without a model the plain name."""
    return F.when(model.isNull() | (model == ""), F.lit(f"reports/{name}.json")).otherwise(F.concat(F.lit(f"reports/{name}_"), model, F.lit(".json")))


def destination(root: str, name: Column | str) -> Column:
    """A path below ``root``; null for a name that would leave it."""
    return F.when(safe_relative_path(name), F.concat(F.lit(root.rstrip("/") + "/"), _col(name)))


def demo_urls(page: Column | str, section: str, extension: str = "html") -> Column:
    """Distinct addresses in the page from the first mark of a section on."""
    text = _col(page)
    at = F.locate(section, text)
    body = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"href=\"([^\"#?]+)\""), 1)))


def interval_text(rate: Column, lower: Column, upper: Column) -> Column:
    """``12.3% [10.0, 14.9]``; an en dash for an empty group."""
    return F.when(rate.isNull(), "–").otherwise(F.format_string("%.1f%% [%.1f, %.1f]", 100 * rate, 100 * lower, 100 * upper))


#: What TeX reads as its own, and how to write it (fixed values).
TEX_ESCAPES = {"\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}


def tex_text(x: Column | str) -> Column:
    """A text as TeX prints it: every letter that TeX reads as its own is escaped once."""
    letters = F.split(_col(x), "")
    escapes = F.create_map(*[F.lit(v) for kv in TEX_ESCAPES.items() for v in kv])
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.element_at(escapes, c), c)), "")


def table_row(*cells: Column, tex: bool = False) -> Column:
    """One row of a Markdown or TeX table."""
    return F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")) if tex else F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
