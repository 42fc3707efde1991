"""Strict JSON: loading, canonical text, digests, claim slots and exact source spans."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StrictError(ValueError):
    """JSON that a lenient reader would accept."""


def loads(text: str):
    """JSON without repeated keys, NaN, infinities or numbers that overflow."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise StrictError("repeated key")
        return out

    def constant(name: str):
        raise StrictError(f"{name} is not JSON")

    def number(token: str) -> float:
        out = float(token)
        if not math.isfinite(out):
            raise StrictError("number out of range")
        return out

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)


def canonical(value) -> str:
    """Sorted keys, no spaces, non-ASCII kept, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    data = value if isinstance(value, bytes) else canonical(value).encode()
    return hashlib.sha256(data).hexdigest()


def slot_id(subject, field, scope, item_key=None, period=None) -> str:
    """Identity of a fact slot; the value does not take part."""
    return digest([subject, field, scope, item_key, period])


def _json_text(col: Column) -> Column:
    text = F.to_json(F.array(col))
    return F.when(col.isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def claim_id(subject: Column, field: Column, scope: Column, item_key: Column | None = None, period: Column | None = None) -> Column:
    """slot_id of string columns, in SQL functions; period: canonical JSON text or null."""
    none = F.lit(None).cast("string")
    parts = [_json_text(c) for c in (subject, field, scope, none if item_key is None else item_key)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts, F.coalesce(none if period is None else period, F.lit("null"))), F.lit("]")), 256)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical text of strict JSON, null where it is not."""

    def one(t):
        try:
            return None if t is None else canonical(loads(t))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.BooleanType())
def is_strict_json(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            loads(t)
        except (ValueError, TypeError):
            return False
        return True

    return texts.map(one)


_DECODER = json.JSONDecoder()
_SPACE = " \t\r\n"


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _SPACE:
        at += 1
    return at


def members(text: str, at: int) -> Iterator[tuple[object, int, int]]:
    """(key or index, start, end) of the values of the object or array that begins at a place."""
    at = _skip(text, at)
    closing = {"{": "}", "[": "]"}.get(text[at : at + 1])
    if not closing:
        return
    at, index = _skip(text, at + 1), 0
    while at < len(text) and text[at] != closing:
        key: object = index
        if closing == "}":
            key, at = _DECODER.raw_decode(text, at)
            at = _skip(text, _skip(text, at) + 1)
        _, end = _DECODER.raw_decode(text, at)
        yield key, at, end
        index += 1
        at = _skip(text, end)
        if text[at : at + 1] == ",":
            at = _skip(text, at + 1)


def span(text: str, path: list) -> tuple[int, int] | None:
    """(start, end) of the exact source text of the value at a path of keys and indices; null if there is none."""
    at, end = _skip(text, 0), len(text.rstrip(_SPACE))
    for step in path:
        hit = next(((s, e) for k, s, e in members(text, at) if k == step and isinstance(k, str) == isinstance(step, str)), None)
        if hit is None:
            return None
        at, end = hit
    return at, end


def value_span(text: str, key: str) -> tuple[int, int] | None:
    """The exact source text of a top-level member."""
    return span(text, [key])


@F.pandas_udf(T.StringType())
def span_text(texts: pd.Series, paths: pd.Series) -> pd.Series:
    """The exact source text at a path that is given as a JSON array of keys and indices."""

    def one(t, p):
        try:
            found = span(t, json.loads(p))
        except (ValueError, TypeError):
            return None
        return None if found is None else t[found[0] : found[1]]

    return pd.Series([one(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)
