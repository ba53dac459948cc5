"""Identity of message content: canonical JSON, media digests, cache composition, vocabularies.

Canonical JSON (sorted keys, no spaces, floats in their shortest form) has no built-in, so it runs in Arrow batches;
what is only hashing or slicing is built in.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Part types that are text, and bounds of integers that keep their form.
TEXT_TYPES = ("text", "input_text")
LEAST_INT, GREATEST_INT = -(1 << 63), (1 << 64) - 1


def _number(x: float) -> str:
    """Shortest digits; plain with the point at most 16 places after and 4 before the first digit, else with an exponent."""
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    lead = "-" if sign else ""
    if x == 0:
        return lead + "0.0"
    if -5 < point <= 0:
        return f"{lead}0.{'0' * -point}{text}"
    if 0 < point <= 16:
        return f"{lead}{text[:point].ljust(point, '0')}.{text[point:] or '0'}"
    return f"{lead}{text[0]}{'.' + text[1:] if text[1:] else ''}e{point - 1}"


def canonical(value: object) -> str:
    """Compact JSON with keys sorted by code point, at every depth."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) or (type(value) is int and not LEAST_INT <= value <= GREATEST_INT):
        return _number(float(value))
    return json.dumps(value, ensure_ascii=False)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _loaded(text: str) -> object:
    return json.loads(text, parse_constant=_no_constant)


def media(content: object) -> list:
    """The parts of a message's content that aren't text."""
    parts = content if isinstance(content, list) else [content]
    if content is None:
        return []
    return [p for p in parts if not isinstance(p, str) and not (isinstance(p, dict) and p.get("type") in TEXT_TYPES and isinstance(content, list))]


def digest(messages: str | None) -> str | None:
    """Sha-256 of the canonical non-text parts, each behind its length in bytes; empty without any; None if it isn't a list of messages."""
    if messages is None:
        return None
    try:
        parts = [canonical(p).encode() for m in _loaded(messages) for p in media(m.get("content"))]
    except (ValueError, TypeError, AttributeError, RecursionError, OverflowError):
        return None
    return hashlib.sha256(b"".join(b"%d:%b" % (len(p), p) for p in parts)).hexdigest() if parts else ""


@F.pandas_udf(StringType())
def content_digest(messages: pd.Series) -> pd.Series:
    return messages.map(digest, na_action="ignore")


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Null where the text isn't JSON."""

    def one(t: str) -> str | None:
        try:
            return canonical(_loaded(t))
        except (ValueError, RecursionError, OverflowError):
            return None

    return text.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def vocabulary_hash(vocabulary: pd.Series) -> pd.Series:
    """16 hex digits of a JSON object of pieces and ids, told by its sorted items."""
    return vocabulary.map(lambda t: hashlib.sha256(repr(sorted(json.loads(t).items())).encode()).hexdigest()[:16], na_action="ignore")


def composition(names: Column) -> Column:
    """16 hex digits of the ordered class names of a cache."""
    return F.substring(F.sha2(F.array_join(names, ","), 256), 1, 16)


def scanned(text: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` (like `$.a.b`) of a JSON text, as ``kind``; null if the text is broken, the path is absent or the value is of another kind."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
