"""Deterministic token streams and payloads for tests of the engine, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a text, their modulus, the words a token has in the synthetic payload and the factor of its id.
TOKENS, MODULUS = 8, 1 << 31
WORDS, FACTOR = 256, 31
SEGMENT = " | "


def _word(hexed: Column, i: Column) -> Column:
    """The i-th 32-bit little-endian word of hex digits."""
    byte = lambda k: F.substring(hexed, i * 8 + F.lit(2 * k + 1), F.lit(2))
    return F.conv(F.concat(*[byte(k) for k in (3, 2, 1, 0)]), 16, 10).cast("bigint")


def synthetic(text: Column) -> Column:
    """Eight tokens from the text's sha-256."""
    return F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: _word(F.sha2(text, 256), i) % MODULUS)


def hinge(text: Column) -> Column:
    """One token told by the whole text."""
    return _word(F.sha2(text, 256), F.lit(0)).bitwiseAND(F.lit(MODULUS - 1))


def growing(prompt: Column, base: str) -> Column:
    """Tokens that an appended segment extends: those of ``base``, then of each segment up to the closing quote; ``synthetic`` without ``base``."""
    at = F.instr(prompt, base)
    rest = F.substring_index(F.substring(prompt, at + len(base), F.length(prompt)), '"', 1)
    own = F.substring(rest, F.when(F.startswith(rest, F.lit(SEGMENT)), len(SEGMENT) + 1).otherwise(1), F.length(rest))
    parts = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(own, r" \| "))
    return F.when(at > 0, F.flatten(F.concat(F.array(synthetic(F.lit(base))), F.transform(parts, synthetic)))).otherwise(synthetic(prompt))


def synthetic_kv(tokens: Column) -> Column:
    """Payload of a token array: each token's word (id times 31 plus place, 32 bits, little-endian) 256 times over."""

    def body(t: Column, i: Column) -> Column:
        h = F.lpad(F.hex((t * FACTOR + i).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.repeat(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), WORDS)

    return F.unhex(F.array_join(F.transform(tokens, body), ""))
