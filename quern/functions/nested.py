"""Checks and walks of nested JSON of any depth, which columns cannot express."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Keys that must not be published, and prefixes of local paths (fixed values).
PRIVATE_KEYS = ("runtime_path", "path", "local_path", "title", "artist", "email", "url_query")
LOCAL_PREFIXES = ("/Users/", "/home/", "/mnt/", "/tmp/", "file://")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


#: Columns of the table functions.
OBJECTS = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("object", T.StringType())])


class DuplicateKey(ValueError):
    """A JSON object names a key twice."""


def unique_pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise DuplicateKey("duplicate key")
    return out


def objects(value: object) -> Iterator[dict]:
    """Every object inside a value, itself first, in document order."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def private_problems(value: object, trail: str = "$") -> Iterator[str]:
    """Places of private keys, local paths and e-mail addresses."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k in PRIVATE_KEYS:
                yield f"{trail}.{k}: private key"
            else:
                yield from private_problems(v, f"{trail}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from private_problems(v, f"{trail}[{i}]")
    elif isinstance(value, str):
        if value.startswith(LOCAL_PREFIXES):
            yield f"{trail}: local path"
        elif _EMAIL.search(value):
            yield f"{trail}: e-mail address"


@pandas_udf(T.ArrayType(T.StringType()))
def json_problems(s: pd.Series) -> pd.Series:
    """Problems of each JSON text; text that is no JSON, or repeats a key, is a problem too."""
    def check(x: str | None) -> list[str]:
        if x is None:
            return []
        try:
            return list(private_problems(json.loads(x, object_pairs_hook=unique_pairs)))
        except DuplicateKey:
            return ["$: duplicate key"]
        except ValueError:
            return ["$: not JSON"]

    return s.map(check)


def remap_ids(mapping: dict[str, str], field: str = "track_id"):
    """A column function that renames the ids found under ``field`` at any depth."""
    def change(x: object) -> object:
        if isinstance(x, dict):
            return {k: mapping.get(v, v) if k == field and isinstance(v, str) else change(v) for k, v in x.items()}
        return [change(v) for v in x] if isinstance(x, list) else x

    @pandas_udf(T.StringType())
    def remap(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(change(json.loads(x)), sort_keys=True))

    return remap


@F.udtf(returnType=OBJECTS)
class JsonObjects:
    """Table function: every object inside a JSON text."""

    def eval(self, text: str):
        if text is not None:
            for i, x in enumerate(objects(json.loads(text))):
                yield i, json.dumps(x, sort_keys=True)


def replaced_strings(target: str, replacement: str):
    """A column function that replaces a text inside every string value of a JSON text."""
    def change(x: object) -> object:
        if isinstance(x, dict):
            return {k: change(v) for k, v in x.items()}
        if isinstance(x, list):
            return [change(v) for v in x]
        return x.replace(target, replacement) if isinstance(x, str) else x

    @pandas_udf(T.StringType())
    def replace(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(change(json.loads(x)), sort_keys=True))

    return replace


#: Fields of a page's clip or song object that make up its flat record.
CLIP_FIELDS = ("generator_version", "model_name", "created_at", "creator_handle", "creator_id", "status", "duration_seconds", "error")
SONG_FIELDS = ("song_id", "creator_id", "artist", "created_at", "published_at", "generator_version", "generation_id", "duration_seconds", "error")


def _one_record(found: list[dict], what: str) -> dict:
    if not found:
        return {"error": f"no {what} object of this id"}
    if any(x != found[0] for x in found[1:]):
        return {"error": f"conflicting {what} objects"}
    return found[0]


def clip_record(items: list[dict], media_id: str) -> dict:
    """The one record of the clip objects with this id that name a model; what the objects or a
    version and its badge say differently is an error."""
    found = []
    for clip in items:
        if clip.get("id") != media_id or not any(k in clip for k in ("major_model_version", "model_version", "model_name")):
            continue
        meta = clip.get("metadata") or {}
        version = clip.get("major_model_version") or clip.get("model_version")
        badge = ((meta.get("model_badges") or {}).get("songcard") or {}).get("display_name")
        if badge and version and badge != version:
            return {"error": "conflicting version evidence"}
        found.append({
            "generator_version": version, "model_name": clip.get("model_name"), "created_at": clip.get("created_at"), "creator_handle": clip.get("handle"),
            "creator_id": clip.get("user_id"), "status": clip.get("status"), "duration_seconds": meta.get("duration"),
        })
    return _one_record(found, "clip")


def song_record(items: list[dict], media_id: str) -> dict:
    """The one record of the song objects whose paths hold this id as a whole part."""
    def linked(song: dict) -> bool:
        paths = (song.get(k) for k in ("song_path", "video_path", "original_song_path"))
        return "generation_id" in song and any(isinstance(p, str) and media_id in p.split("?")[0].split("#")[0].split("/") for p in paths)

    found = [
        {
            "song_id": x.get("id"), "creator_id": x.get("user_id"), "artist": x.get("artist"), "created_at": x.get("created_at"), "published_at": x.get("published_at"),
            "generator_version": x.get("model_version") or x.get("modelVersion"), "generation_id": x.get("generation_id"), "duration_seconds": x.get("duration"),
        }
        for x in items if linked(x)
    ]
    return _one_record(found, "song")


def record_of(kind: str):
    """A column function of a JSON list of objects and an id: the flat record, all fields as texts."""
    fields, read = (CLIP_FIELDS, clip_record) if kind == "clip" else (SONG_FIELDS, song_record)

    @pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    def record(items: pd.Series, ids: pd.Series) -> pd.DataFrame:
        made = [read(list(objects(json.loads(x))), i) for x, i in zip(items, ids)]
        return pd.DataFrame([{f: None if r.get(f) is None else str(r[f]) for f in fields} for r in made], columns=fields, dtype=object)

    return record


@pandas_udf(T.MapType(T.StringType(), T.StringType()))
def string_map(s: pd.Series) -> pd.Series:
    """A JSON object of texts as a map; a key that it names twice is an error."""
    return s.map(lambda x: None if x is None else {str(k): str(v) for k, v in json.loads(x, object_pairs_hook=unique_pairs).items()})
