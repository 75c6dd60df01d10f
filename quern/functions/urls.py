"""URL keys and checks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import _col


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def url_key(x: Column | str) -> Column:
    """Scheme, lower-case host, path and query, for comparison; null for user data or no host."""
    url = _col(x)
    host, query = F.lower(_part(url, "HOST")), _part(url, "QUERY")
    key = F.concat(F.lower(_part(url, "PROTOCOL")), F.lit("://"), host, F.coalesce(_part(url, "PATH"), F.lit("")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when(_part(url, "USERINFO").isNull() & host.isNotNull(), key)


def has_path_segment(x: Column | str, segment: Column | str) -> Column:
    """Whether a whole segment of the URL's path equals ``segment``."""
    return F.coalesce(F.array_contains(F.split(_part(_col(x), "PATH"), "/"), _col(segment)), F.lit(False))


def public_url_problem(x: Column | str) -> Column:
    """Why a URL must not be published; null if it may."""
    url = _col(x)
    return (
        F.when(url.isNull() | (url == ""), F.lit(None))
        .when(F.coalesce(_part(url, "PROTOCOL"), F.lit("")) != "https", "not_https")
        .when(_part(url, "HOST").isNull(), "no_host")
        .when(_part(url, "USERINFO").isNotNull(), "user_data")
        .when(_part(url, "QUERY").isNotNull(), "query")
    )


def lineage_tokens(value: Column | str, provider: Column | str) -> Column:
    """Namespaced 32-digit ids in a value or, for a URL, in its path; sentinels are dropped."""
    v = _col(value)
    tokens = F.when(v.startswith("https://"), F.split(_part(v, "PATH"), "/")).otherwise(F.array(v))
    compact = F.transform(tokens, lambda t: F.lower(F.replace(t, F.lit("-"), F.lit(""))))
    ids = F.filter(compact, lambda t: t.rlike("^[0-9a-f]{32}$") & (t != "0" * 32))
    return F.coalesce(F.array_distinct(F.transform(ids, lambda t: F.concat(_col(provider), F.lit(":"), t))), F.array().cast("array<string>"))


def identity_kind(value: Column | str) -> Column:
    """``kind:id`` of a path or track id: a generated stem, or a number in a known corpus."""
    v = _col(value).cast("string")
    stem = F.substring_index(F.substring_index(F.substring_index(v, "/", -1), ":", -1), ".", 1)
    low = F.lower(v)
    number = stem.rlike(r"^\d+$")
    return (
        F.when(stem.rlike(r"^fake_\d+_(suno|udio)"), F.concat(F.lit("sonics:"), stem))
        .when(low.contains("fma") & number, F.concat(F.lit("fma:"), stem.try_cast("long").cast("string")))
        .when(low.contains("jamendo") & number, F.concat(F.lit("mtg:"), stem.try_cast("long").cast("string")))
    )
