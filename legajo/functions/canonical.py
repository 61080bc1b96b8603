"""One serialisation and digest of nested data, whatever the order of its keys."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> object:
    """Keys sorted, white space of strings collapsed, numbers without a fraction as integers."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [canonical(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return " ".join(value.split()) if isinstance(value, str) else value


def canonical_json(text: str | None) -> str | None:
    """The one form of a JSON text; null for null, broken and too deeply nested ones."""
    try:
        return json.dumps(canonical(json.loads(text)), ensure_ascii=False, separators=(",", ":"), allow_nan=False)  # type: ignore[arg-type]
    except (ValueError, TypeError, RecursionError, OverflowError):
        return None


def canonical_digest(text: Column, salt: str = "") -> Column:
    """SHA-256 of the one form of JSON ``text``, behind a salt."""

    def digest(texts: pa.Array) -> pa.Array:
        forms = (canonical_json(t) for t in texts.to_pylist())
        return pa.array([None if f is None else hashlib.sha256((salt + f).encode()).hexdigest() for f in forms], pa.string())

    return F.arrow_udf(digest, "string")(text.cast("string"))
