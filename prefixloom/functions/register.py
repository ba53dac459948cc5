"""The engine's functions under SQL names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import chunks, forensics, vectors
from ..sources import wire
from . import content, keys


def _fold(words: list[int]) -> str:
    """The two lanes of ``keys.fnv128`` in plain numbers."""
    mask, out = (1 << 64) - 1, []
    for seed, prime in zip(keys.SEEDS, keys.PRIMES):
        h = seed & mask
        for w in words:
            h = ((h ^ w & 0xFFFFFFFF) * (prime & mask)) & mask
        out.append(f"{h:016x}")
    return out[1] + out[0]


def _words(text: str) -> list[int]:
    b = text.encode()
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


@F.pandas_udf(StringType())
def blob_key(fingerprint: pd.DataFrame, engine: pd.Series, tokens: pd.Series) -> pd.Series:
    """A checkpoint's key of its fingerprint (a struct of named fields), engine and tokens; equal to ``keys.blob_key``."""
    field = lambda v: f"{len(v.encode())}:{v}"

    def one(fp: dict, engine: str | None, own) -> str:
        plain = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)
        text = "".join(field(plain(fp.get(k))) for k in ("model_id", "tokenizer_hash", "kv_dtype", "kv_layout_version"))
        text += "".join(field(plain(fp.get(k)) or "0") for k in ("kv_bits", "kv_group_size"))
        text += "".join(field(v) for k in ("cache_layout", "content_digest", "kv_tier") if (v := plain(fp.get(k))))
        lead = _words(field(engine)) + [keys.SEPARATOR] if engine and engine != keys.DEFAULT_ENGINE else []
        return _fold([*lead, *_words(text), keys.SEPARATOR, *map(int, own)])

    return pd.Series([one(fp, e, t) for fp, e, t in zip(fingerprint.to_dict("records"), engine, tokens)])


@F.pandas_udf(DoubleType())
def score_packed(packed: pd.Series, norm: pd.Series, query: pd.Series, bits: pd.Series) -> pd.Series:
    """The dot product of a coded vector with a query, taken on the code."""

    def one(p, n, q, b) -> float | None:
        if p is None or q is None:
            return None
        q = np.asarray(q, np.float64)
        d = len(q)
        return float(vectors.codebook(d, int(b))[vectors.unpack(np.asarray(p)[None], int(b), d)[0]] @ (vectors.rotation(d) @ q) * n / np.sqrt(d))

    return pd.Series([one(*x) for x in zip(packed, norm, query, bits)])


@F.udtf(returnType=StructType([StructField("chunk_no", IntegerType()), StructField("end_off", LongType()), StructField("size", LongType()), StructField("digest", StringType())]))
class ContentChunks:
    """content_chunks(payload, average): a row per content-defined chunk."""

    def eval(self, payload: bytes, average: int) -> Iterator[tuple]:
        data = bytes(payload or b"")
        ends = chunks.cut(data, average, chunks.gear_table())
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            yield i, b, b - a, hashlib.sha256(data[a:b]).hexdigest()


FUNCTIONS = {
    "canonical_json": content.canonical_json,
    "content_digest": content.content_digest,
    "vocabulary_hash": content.vocabulary_hash,
    "first_diff": forensics.first_diff,
    "tensor_fault": wire.tensor_faults,
    "blob_key": blob_key,
    "score_packed": score_packed,
}
TABLE_FUNCTIONS = {"content_chunks": ContentChunks}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes every function of FUNCTIONS and TABLE_FUNCTIONS callable from ``spark.sql``; returns the names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(prefix + name, function)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(prefix + name, function)
    return [prefix + name for name in (*FUNCTIONS, *TABLE_FUNCTIONS)]
