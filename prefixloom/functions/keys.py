"""Identity keys: length-prefixed fields, little-endian words, a dual-lane FNV fold, and digests, all built in."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# FNV seeds and primes of the two lanes (as signed 64-bit), and the separator word.
SEEDS = (0xCBF29CE484222325 - (1 << 64), 0x9E3779B97F4A7C15 - (1 << 64))
PRIMES = (0x100000001B3, 0x880355F21E6D1965 - (1 << 64))
SEPARATOR = 0xFFFFFFFF
DEFAULT_ENGINE = "mlx-lm"


@contextmanager
def wrapping(spark: SparkSession):
    """Multiplication wraps inside: the flag is bound when a DataFrame is built, and restored after."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def field(c: Column) -> Column:
    """`len:field`, the length in bytes."""
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def words_le(text: Column) -> Column:
    """The UTF-8 bytes as unsigned 32-bit little-endian words, the last one padded with zeros."""
    h = F.hex(text.cast("binary"))
    n = F.ceil(F.length(h) / 8).cast("int")
    padded = F.rpad(h, n * 8, "0")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def word(i: Column) -> Column:
        byte = lambda k: F.substring(padded, i * 8 + F.lit(1 + 2 * k), F.lit(2))
        return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("bigint")

    return F.transform(at, word)


def fnv128(words: Column) -> Column:
    """32 hex digits: the second lane's fold over 32-bit words, then the first's. To be built inside ``wrapping``."""
    masked = F.transform(words, lambda w: w.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    lanes = [_lane(masked, seed, prime) for seed, prime in zip(SEEDS, PRIMES)]
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in reversed(lanes)]))


def _lane(words: Column, seed: int, prime: int) -> Column:
    return F.aggregate(words, F.lit(seed).cast("bigint"), lambda h, x: h.bitwiseXOR(x) * F.lit(prime).cast("bigint"))


def prefix_hash(tokens: Column) -> Column:
    return fnv128(tokens)


def completion_id(tokens: Column) -> Column:
    return F.concat(F.lit("chatcmpl-"), prefix_hash(tokens))


def blob_key(fingerprint: dict[str, Column], engine: Column, tokens: Column) -> Column:
    """Key of a checkpoint. The engine's words come first unless it is the default; optional fields only where they aren't empty."""
    sep = F.array(F.lit(SEPARATOR).cast("bigint"))
    none = F.array().cast("array<bigint>")
    parts = [field(fingerprint[k].cast("string")) for k in ("model_id", "tokenizer_hash", "kv_dtype", "kv_layout_version")]
    parts += [field(F.coalesce(fingerprint.get(k, F.lit(0)).cast("string"), F.lit("0"))) for k in ("kv_bits", "kv_group_size")]
    for k in ("cache_layout", "content_digest", "kv_tier"):
        v = F.coalesce(fingerprint.get(k, F.lit("")), F.lit(""))
        parts.append(F.when(v != "", field(v)).otherwise(""))
    engine = F.coalesce(F.nullif(engine, F.lit("")), F.lit(DEFAULT_ENGINE))
    lead = F.when(engine != DEFAULT_ENGINE, F.concat(words_le(field(engine)), sep)).otherwise(none)
    return fnv128(F.concat(lead, words_le(F.concat(*parts)), sep, tokens.cast("array<bigint>")))


def model_hash(key_without_tokens: Column) -> Column:
    return F.substring(key_without_tokens, 1, 16)


def tier(label: Column) -> Column:
    """Struct (key_bits, value_bits, group_size) of a tier label, null if it breaks the grammar."""
    pattern = r"^tq-k([234])v([23468])-g([0-9]{1,9})$"
    part = lambda i: F.regexp_extract(label, pattern, i)
    group = F.when(label.rlike(pattern), part(3).cast("int"))
    return F.when(group >= 2, F.struct(part(1).cast("int").alias("key_bits"), part(2).cast("int").alias("value_bits"), group.alias("group_size")))
