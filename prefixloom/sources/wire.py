"""Checkpoint blobs, chunk manifests, segments and tensor headers as binary columns.

Blob: little-endian u32 header length, JSON header, payload. Manifest: `MCKM`, version, payload length,
chunk count, 56-byte records. Segment: `MCSG`, version, records of u32 length, 32-byte digest, body.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_HEADER = 1 << 20
FINGERPRINT = "model_id string, tokenizer_hash string, kv_dtype string, kv_layout_version bigint, kv_bits int, kv_group_size bigint, cache_layout string, content_digest string, kv_tier string"
HEADER = f"fingerprint struct<{FINGERPRINT.replace(' string', ':string').replace(' bigint', ':bigint').replace(' int', ':int')}>, token_count bigint, tokens array<bigint>, format_version int, payload_sha256 string, engine_id string, granularity int"


def le_int(data: Column, start: int, width: int) -> Column:
    """The unsigned little-endian integer of ``width`` bytes from byte ``start`` (from 0), as decimal for 8 bytes, else long."""
    part = F.hex(F.substring(data, start + 1, width))
    turned = F.concat(*[F.substring(part, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.conv(turned, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def blobs(spark: SparkSession, path: str, pattern: str = "*.ckpt") -> DataFrame:
    """path, content of the matching files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with header fields, payload and reject (null, `header`, `version`, `tokens` or `digest`)."""
    c = F.col(content)
    n = F.when(F.octet_length(c) >= 4, le_int(c, 0, 4))
    fits = n.between(2, MAX_HEADER) & (n + 4 <= F.octet_length(c))
    text = F.when(fits, F.try_to_binary(F.hex(F.substring(c, F.lit(5), n.cast("int"))), F.lit("hex")).cast("string"))
    out = files.withColumn("_h", F.from_json(text, HEADER, {"mode": "PERMISSIVE"})).withColumn("payload", F.when(fits, F.substring(c, n.cast("int") + 5, F.octet_length(c))))
    out = out.select(*[x for x in files.columns if x != content], "_h.*", "payload")
    v = F.col("format_version")
    small = lambda f: F.coalesce(F.col(f"fingerprint.{f}"), F.lit(0)) < 0
    odd = ~F.coalesce(F.col("granularity"), F.lit(0)).isin(0, 1) | small("kv_bits") | small("kv_group_size") | small("kv_layout_version")
    lacking = F.col("fingerprint.tokenizer_hash").isNull() | F.col("fingerprint.kv_dtype").isNull() | F.col("fingerprint.kv_layout_version").isNull() | F.col("token_count").isNull()
    reject = (
        F.when(F.col("fingerprint").isNull() | F.col("tokens").isNull() | F.col("fingerprint.model_id").isNull() | lacking | odd, "header")
        .when(v.isNull() | ~v.isin(1, 2, 3), "version")
        .when((v >= 2) & F.col("payload_sha256").isNull(), "version")
        .when((F.size("tokens") != F.col("token_count")) | F.exists("tokens", lambda t: t.isNull() | (t < 0) | (t > 0xFFFFFFFF)), "tokens")
        .when((v >= 2) & ~F.coalesce(F.sha2("payload", 256) == F.lower("payload_sha256"), F.lit(False)), "digest")
    )
    return out.withColumn("reject", reject)


def encode(header: dict, payload: bytes) -> bytes:
    """A blob; empty and absent fields are left out, separators are compact."""
    lean = lambda d: {k: lean(v) if isinstance(v, dict) else v for k, v in d.items() if v not in (None, "", 0) or k in ("token_count", "kv_layout_version")}
    text = json.dumps(lean(header), separators=(",", ":"), ensure_ascii=False).encode()
    return struct.pack("<I", len(text)) + text + payload


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Header fields and payload_bytes only: payloads are neither kept nor digested, so the reject of a bad digest is not given."""
    n = F.octet_length(F.col(content))
    out = decoded(files.withColumn("file_bytes", n.cast("long")), content)
    return out.drop("payload").withColumn("reject", F.when(F.col("reject") != "digest", F.col("reject")))


def manifest_faults(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key`` and reject of each manifest (null if it is sound): magic, version, truncated, geometry, placement or coverage."""
    c = F.col(content)
    n = F.octet_length(c)
    count = F.when(n >= 22, le_int(c, 14, 8))
    first = F.when((n < 22) | (F.substring(c, 1, 4) != F.lit(b"MCKM")), "magic").when(le_int(c, 4, 2) != 1, "version").when(count * 56 + 22 > n, "truncated")
    head = files.select(F.col(key), first.alias("reject"), F.when(n >= 22, le_int(c, 6, 8)).alias("_len"), count.alias("_n"))
    r = _references(files.where(first.isNull()), key, content)
    end = F.col("first_off") + F.greatest(F.col("n_heads") - 1, F.lit(0)) * F.col("head_stride") + F.col("per_head_len")
    worst = r.groupBy(key).agg(F.max((F.col("n_heads") == 0) | (F.col("per_head_len") == 0)).alias("_empty"), F.max(end).alias("_end"))
    j = head.join(worst, key, "left")
    whole = F.coalesce("_end", F.lit(0).cast("decimal(38,0)")) == F.col("_len")
    own = F.when(F.col("_empty"), "geometry").when(F.col("_end") > F.col("_len"), "placement").when(~whole, "coverage")
    return j.select(key, F.coalesce("reject", own).alias("reject"))


def _references(files: DataFrame, key: str, content: str) -> DataFrame:
    """The records of manifests, their numbers as decimals."""
    c = F.col(content)
    count = le_int(c, 14, 8).cast("bigint")
    rows = files.select(key, c, count.alias("_n")).withColumn("_i", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    rows = rows.select(key, F.substring(c, F.lit(23) + 56 * F.col("_i"), F.lit(56)).alias("_r"))
    at = lambda start, width: le_int(F.col("_r"), start, width).cast("decimal(20,0)")
    return rows.select(key, at(32, 4).alias("per_head_len"), at(36, 4).alias("n_heads"), at(40, 8).alias("first_off"), at(48, 8).alias("head_stride"))


def manifests(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """A row per chunk reference of each sound manifest: chunk_no, digest, per_head_len, n_heads, first_off, head_stride, payload_len. ``manifest_faults`` names the others."""
    c = F.col(content)
    sound = manifest_faults(files, key, content).where("reject IS NULL").select(key)
    ok = files.join(sound, key, "left_semi")
    count = le_int(c, 14, 8).cast("bigint")
    rows = ok.select(key, c, le_int(c, 6, 8).cast("bigint").alias("payload_len"), count.alias("_n"))
    rows = rows.withColumn("chunk_no", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    r = F.substring(c, F.lit(23) + 56 * F.col("chunk_no"), F.lit(56))
    rows = rows.select(key, "payload_len", "chunk_no", r.alias("_r"))
    digest = F.lower(F.hex(F.substring("_r", 1, 32)))
    at = lambda start, width: le_int(F.col("_r"), start, width).cast("bigint")
    return rows.select(key, "chunk_no", digest.alias("digest"), at(32, 4).alias("per_head_len"), at(36, 4).alias("n_heads"), at(40, 8).alias("first_off"), at(48, 8).alias("head_stride"), "payload_len")


def encode_manifest(payload_len: int, refs: list[tuple[bytes, int, int, int, int]]) -> bytes:
    return b"MCKM" + struct.pack("<HQQ", 1, payload_len, len(refs)) + b"".join(d + struct.pack("<IIQQ", *rest) for d, *rest in refs)


def segments(files: DataFrame, content: str = "content") -> DataFrame:
    """Records (seg, rec_off, body_len, digest, body) of segment files (seg, content); a cut tail ends its file, files under 8 bytes are empty.

    Files with a bad magic or version have no records; ``segment_faults`` names them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seg, data in zip(batch["seg"], batch[content]):
                data = bytes(data)
                if len(data) < 8 or data[:4] != b"MCSG" or struct.unpack_from("<H", data, 4)[0] != 1:
                    continue
                at = 8
                while at + 36 <= len(data):
                    n = struct.unpack_from("<I", data, at)[0]
                    if at + 36 + n > len(data):
                        break
                    rows.append((seg, at, n, data[at + 4 : at + 36].hex(), data[at + 36 : at + 36 + n]))
                    at += 36 + n
            yield pd.DataFrame(rows, columns=["seg", "rec_off", "body_len", "digest", "body"])

    return files.select("seg", content).mapInPandas(run, "seg long, rec_off long, body_len long, digest string, body binary")


def segment_faults(files: DataFrame, content: str = "content") -> DataFrame:
    """seg and reject (magic, version; null if it is sound, or too short to be anything)."""
    c = F.col(content)
    bad = F.when(F.substring(c, 1, 4) != F.lit(b"MCSG"), "magic").when(le_int(c, 4, 2) != 1, "version")
    return files.select("seg", F.when(F.octet_length(c) >= 8, bad).alias("reject"))


def encode_segment(bodies: list[bytes]) -> bytes:
    return b"MCSG" + struct.pack("<HH", 1, 0) + b"".join(struct.pack("<I", len(b)) + hashlib.sha256(b).digest() + b for b in bodies)


_NUMPY = {"F32": "<f4", "U32": "<u4", "F64": "<f8", "U8": "|u1"}


def encode_tensors(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> bytes:
    """A tensor payload: header length, JSON header (metadata, then tensors by name with their offsets), bytes."""
    names = {np.dtype(v): k for k, v in _NUMPY.items()}
    header, parts, at = {"__metadata__": metadata} if metadata else {}, [], 0
    for name in sorted(tensors):
        data = np.ascontiguousarray(tensors[name])
        header[name] = {"dtype": names[data.dtype], "shape": list(data.shape), "data_offsets": [at, at + data.nbytes]}
        parts.append(data.tobytes())
        at += data.nbytes
    text = json.dumps(header, separators=(",", ":")).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(parts)


def decode_tensors(payload: bytes) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """Tensors and metadata of a payload that has no fault."""
    if (fault := tensor_fault(payload)) is not None:
        raise ValueError(f"no tensor payload: {fault}")
    n = int.from_bytes(payload[:8], "little")
    header = json.loads(payload[8 : 8 + n])
    meta = header.pop("__metadata__", {})
    out = {}
    for name, spec in header.items():
        a, b = spec["data_offsets"]
        out[name] = np.frombuffer(payload[8 + n + a : 8 + n + b], _NUMPY[spec["dtype"]]).reshape(spec["shape"])
    return out, meta


# Bytes of an element by tensor dtype.
DTYPE_BYTES = {"BOOL": 1, "U8": 1, "I8": 1, "U16": 2, "I16": 2, "F16": 2, "BF16": 2, "U32": 4, "I32": 4, "F32": 4, "U64": 8, "I64": 8}


def _whole(values: object) -> bool:
    return isinstance(values, list) and all(type(v) is int for v in values)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def tensor_fault(payload: bytes | None) -> str | None:
    """Why a tensor payload is rejected: `length`, `json`, `metadata`, `tensor`, `dtype`, `shape`, `offsets`, `overlap`; None if it is sound."""
    payload = payload or b""
    n = int.from_bytes(payload[:8], "little")
    if len(payload) < 8 or n == 0 or n + 8 > len(payload):
        return "length"
    try:
        header = json.loads(payload[8 : 8 + n].decode("utf-8"), parse_constant=_no_constant)
        json.dumps(header, ensure_ascii=False).encode("utf-8")  # fails on a lone surrogate, at any depth
    except (ValueError, RecursionError):
        return "json"
    if not isinstance(header, dict):
        return "json"
    meta = header.pop("__metadata__", {})
    if not isinstance(meta, dict) or not all(isinstance(v, str) for v in meta.values()):
        return "metadata"
    end = 0
    spans = []
    for spec in header.values():
        if not isinstance(spec, dict):
            return "tensor"
        dtype, shape, at = (spec.get(k) for k in ("dtype", "shape", "data_offsets"))
        if not isinstance(dtype, str) or dtype not in DTYPE_BYTES:
            return "dtype"
        if not _whole(shape) or min(shape, default=0) < 0:
            return "shape"
        if not _whole(at) or len(at) != 2 or not 0 <= at[0] <= at[1] <= len(payload) - 8 - n or at[1] - at[0] != DTYPE_BYTES[dtype] * math.prod(shape):
            return "offsets"
        spans.append(at)
    for start, stop in sorted(spans):
        if start < end:
            return "overlap"
        end = stop
    return None


@F.pandas_udf(StringType())
def tensor_faults(payloads: pd.Series) -> pd.Series:
    return pd.Series([tensor_fault(None if p is None else bytes(p)) for p in payloads], dtype=object)


def tensors(files: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """A row per tensor of a safetensors payload: tensor, dtype, shape, begin, end (absolute), n_heads."""
    c = F.col(payload)
    n = le_int(c, 0, 8).cast("bigint")
    text = F.substring(c, F.lit(9), n.cast("int")).cast("string")
    kind = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"
    rows = files.select(key, n.alias("_n"), F.explode(F.from_json(text, kind)).alias("tensor", "t")).where("tensor <> '__metadata__'")
    offset = lambda i: (F.element_at("t.data_offsets", i) + F.col("_n") + 8).cast("long")
    heads = F.when(F.size("t.shape") >= 2, F.element_at("t.shape", 2)).otherwise(1)
    return rows.select(key, "tensor", "t.dtype", "t.shape", offset(1).alias("begin"), offset(2).alias("end"), heads.cast("long").alias("n_heads"))
