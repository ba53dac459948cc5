"""Identity of checkpoints: nine-field fingerprints, engine domains, names, and the checks before an entry is taken in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keys import DEFAULT_ENGINE
from .gates import first_of
from .policy import UNKNOWN

# The fields, those that count as empty or 0 when absent, and request limits.
FIELDS = {
    "model_id": "string", "tokenizer_hash": "string", "kv_dtype": "string", "kv_layout_version": "bigint", "kv_bits": "int", "kv_group_size": "bigint",
    "cache_layout": "string", "content_digest": "string", "kv_tier": "string",
}
OPTIONAL = ("kv_bits", "kv_group_size", "cache_layout", "content_digest", "kv_tier")
U32 = 0xFFFFFFFF
DEFAULT_TOKENS, MOST_TOKENS = 64, 8192
NAME = r"^[0-9a-f]{32}-[0-9a-f]{16}\.ckpt$"


def fingerprint(**fields: Column) -> Column:
    """The struct of all nine fields; absent optional ones are empty or 0. Two such structs are equal iff every field is, so they join as one key."""
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"no fields of a fingerprint: {sorted(unknown)}")

    def one(name: str) -> Column:
        kind = FIELDS[name]
        value = fields.get(name, F.lit(None)).cast(kind)
        return F.coalesce(value, F.lit("" if kind == "string" else 0).cast(kind)) if name in OPTIONAL else value

    return F.struct(*[one(name).alias(name) for name in FIELDS])


def compatible(a: Column, b: Column) -> Column:
    """Field by field; a fingerprint that lacks a required field fits nothing."""
    same = F.lit(True)
    for name in FIELDS:
        same &= F.coalesce(a[name] == b[name], F.lit(False))
    return same


def layout_compatible(a: Column, b: Column) -> Column:
    """Equal layouts; an empty one fits an empty one only."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def digest_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def differing(a: Column, b: Column) -> Column:
    """Names of the fields that keep two fingerprints apart."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(a[n] == b[n], F.lit(False)), n) for n in FIELDS]))


def engine_domain(engine: Column) -> Column:
    return F.coalesce(F.nullif(engine, F.lit("")), F.lit(DEFAULT_ENGINE))


def engine_meta(engine: Column) -> Column:
    """What a header says: nothing for the default engine."""
    return F.nullif(engine_domain(engine), F.lit(DEFAULT_ENGINE))


def unresolved(fp: Column) -> Column:
    """Identities that are neither looked up nor published."""
    return fp["tokenizer_hash"].isin(*UNKNOWN) | fp["model_id"].isin(*UNKNOWN)


def model_name(model: Column, adapter: Column, draft: Column) -> Column:
    """Model, adapter and draft in one id; ``unresolved`` if one was asked for (not null) and not found (empty)."""
    parts = [model, adapter, draft]
    lost = F.lit(False)
    for p in parts:
        lost |= F.coalesce(p == "", F.lit(False))
    return F.when(lost, UNKNOWN[1]).otherwise(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def publish_refusal(tokens: Column, engine: Column, granularity: Column, fp: Column | None = None) -> Column:
    """Why an entry is refused; null if it is taken."""
    reasons = {
        "prefix_under_two": F.coalesce(F.size(tokens), F.lit(0)) < 2,
        "invalid_tokens": F.exists(tokens, lambda t: t.isNull() | (t < 0) | (t > U32)),
        "invalid_engine": engine.isNull(),
        "invalid_granularity": ~F.coalesce(granularity, F.lit(0)).isin(0, 1),
    }
    return first_of(reasons | ({} if fp is None else {"unresolved_identity": unresolved(fp)}))


def request_refusal(model: Column, served: list[str], max_tokens: Column) -> Column:
    """Why a request is turned away before lookup (and not counted); null if it isn't."""
    return first_of({"unknown_model": ~F.coalesce(model.isin(*served), F.lit(False)), "max_tokens": F.coalesce(max_tokens, F.lit(DEFAULT_TOKENS)) > MOST_TOKENS})


def most_tokens(max_tokens: Column) -> Column:
    return F.coalesce(max_tokens, F.lit(DEFAULT_TOKENS))


def bare(ref: Column) -> Column:
    """A reference that is a plain file name: no path, no traversal."""
    return F.coalesce(~ref.isin("", ".", "..") & ~ref.rlike(r"[/\\\x00]"), F.lit(False))


def blob_name(key: Column, generation: Column) -> Column:
    return F.concat(key, F.lit("-"), F.lower(F.lpad(F.hex(generation.cast("bigint")), 16, "0")), F.lit(".ckpt"))


def bound(name: Column, key: Column) -> Column:
    """The name is its header's: it begins with the key."""
    return F.coalesce(F.startswith(name, F.concat(key, F.lit("-"))), F.lit(False))


def generation(millis: Column, process: Column) -> Column:
    """A number that grows with time and tells processes apart."""
    return F.shiftleft(millis.cast("bigint"), 16).bitwiseOR(process.cast("bigint").bitwiseAND(F.lit(0xFFFF)))


def short_digest(digest: Column) -> Column:
    return F.substring(F.lower(digest), 1, 16)


def unix_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp."""
    return F.unix_millis(ts)


def utc_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone."""
    return F.unix_millis(F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    return end - start
