"""Vector quantisation: Lloyd-Max codebooks, rotation, packing, group quantisation, scores on codes."""

from __future__ import annotations

import functools

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

CODE = StructType([StructField("packed", ArrayType(LongType())), StructField("norm", FloatType())])
GROUPS = StructType([StructField("q", ArrayType(LongType())), StructField("scale", ArrayType(FloatType())), StructField("bias", ArrayType(FloatType()))])


@functools.cache
def codebook(d: int, bits: int, rounds: int = 300) -> np.ndarray:
    """Levels of the Lloyd-Max quantiser of a unit vector's coordinate times sqrt(d): density (1 - u^2 / d) ^ ((d - 3) / 2)."""
    u = np.linspace(-8, 8, 40001)
    p = np.clip(1 - u * u / d, 0, None) ** ((d - 3) / 2)
    mass, moment = np.concatenate(([0], np.cumsum(p))), np.concatenate(([0], np.cumsum(p * u)))
    c = mass / mass[-1]
    levels = np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), c[1:], u)
    for _ in range(rounds):
        at = np.searchsorted(u, np.concatenate(([-8], (levels[1:] + levels[:-1]) / 2, [8.1])))
        m = mass[at[1:]] - mass[at[:-1]]
        new = np.where(m > 0, (moment[at[1:]] - moment[at[:-1]]) / np.maximum(m, 1e-300), levels)
        new = (new - new[::-1]) / 2
        if np.abs(new - levels).max() < 1e-9:
            break
        levels = new
    return levels


@functools.cache
def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A seeded orthogonal matrix; it travels with the frame."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def pack(idx: np.ndarray, bits: int) -> np.ndarray:
    """Rows of indices in 32-bit words, 32 // bits a word."""
    per = 32 // bits
    n, d = idx.shape
    wide = np.zeros((n, -(-d // per) * per), np.uint64)
    wide[:, :d] = idx
    return (wide.reshape(n, -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(2).astype(np.int64)


def unpack(words: np.ndarray, bits: int, d: int) -> np.ndarray:
    per = 32 // bits
    return ((words.astype(np.uint64)[:, :, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)).reshape(len(words), -1)[:, :d].astype(np.int64)


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and compensated norms of the rows of ``x``."""
    d = x.shape[1]
    levels = codebook(d, bits)
    norm = np.linalg.norm(x, axis=1)
    y = (x / np.maximum(norm, 1e-12)[:, None]) @ rotation(d).T * np.sqrt(d)
    idx = np.searchsorted((levels[1:] + levels[:-1]) / 2, y)
    s = np.linalg.norm(levels[idx], axis=1) / np.sqrt(d)
    return pack(idx, bits), (norm / np.maximum(s, 1e-12)).astype(np.float32)


def decode(words: np.ndarray, norm: np.ndarray, bits: int, d: int) -> np.ndarray:
    return codebook(d, bits)[unpack(words, bits, d)] / np.sqrt(d) @ rotation(d) * norm[:, None]


def encoded(vectors: DataFrame, column: str, d: int, bits: int) -> DataFrame:
    """``vectors`` with packed and norm in place of ``column``; a null vector has a null code."""

    def run(x: pd.Series) -> pd.DataFrame:
        ok = x.notna().to_numpy()
        out = pd.DataFrame({"packed": [None] * len(x), "norm": np.full(len(x), np.nan, np.float32)})
        if ok.any():
            words, norm = encode(np.stack(x[ok].to_list()).astype(np.float64), bits)
            out.loc[ok, "packed"] = pd.Series(list(words), index=out.index[ok])
            out.loc[ok, "norm"] = norm
        return out

    run.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
    kept = [c for c in vectors.columns if c != column]
    return vectors.select(*kept, F.pandas_udf(run, CODE)(column).alias("_c")).select(*kept, "_c.*")


def decoded(codes: DataFrame, d: int, bits: int) -> DataFrame:
    """``codes`` (packed, norm) with vector in their place; null for a null code."""

    def run(packed: pd.Series, norm: pd.Series) -> pd.Series:
        ok = packed.notna().to_numpy()
        out = pd.Series([None] * len(packed), dtype=object)
        if ok.any():
            out[ok] = pd.Series(list(decode(np.stack(packed[ok].to_list()), norm[ok].to_numpy(), bits, d).astype(np.float32)), index=out.index[ok])
        return out

    run.__annotations__ = {"packed": pd.Series, "norm": pd.Series, "return": pd.Series}
    return codes.select(*[c for c in codes.columns if c not in ("packed", "norm")], F.pandas_udf(run, "array<float>")("packed", "norm").alias("vector"))


def appended(codes: DataFrame, vectors: DataFrame, column: str, d: int, bits: int) -> DataFrame:
    """Codes of what came before and of what comes now: each vector is coded alone, so this is the code of all at once."""
    return codes.unionByName(encoded(vectors, column, d, bits).select(*codes.columns))


def trimmed(codes: DataFrame, position: str, keep: int) -> DataFrame:
    """Codes of the first ``keep`` positions."""
    return codes.where(F.col(position) < keep)


def group_dequantised(code: Column, group: int) -> Column:
    """The values of ``group_quantised``."""
    return F.transform(code["q"], lambda q, i: q * F.get(code["scale"], F.floor(i / group).cast("int")) + F.get(code["bias"], F.floor(i / group).cast("int")))


def tier_bytes(d: int, key_bits: int, value_bits: int, group: int) -> int:
    """Bytes of a position's key and value under a tier: packed codes, a norm, and a scale and bias (2 bytes each) per group."""
    words = lambda bits: -(-d // (32 // bits)) * 4
    return words(key_bits) + 4 + words(value_bits) + -(-d // group) * 4


def fidelity(states: DataFrame, d: int, tiers: list[tuple[int, int, int]]) -> DataFrame:
    """A row per tier (key bits, value bits, group) of ``states`` (layer, key, value): what encoding and decoding costs.

    A layer's cosine is the lesser of its keys' and values' mean row cosine, rows without a length left out (0 if all are).
    tier, min_layer_cos, mean_layer_cos, bytes_per_token, x_vs_f16.
    """
    layers = states.select("layer").distinct().agg(F.count("*")).scalar()
    out = None
    for kb, vb, g in tiers:
        if d % g:
            raise ValueError(f"vectors of {d} do not divide into groups of {g}")
        k = decoded(encoded(states.withColumn("_k", F.col("key")), "_k", d, kb), d, kb).withColumnRenamed("vector", "_key")
        v = k.withColumn("_value", group_dequantised(group_quantised(F.col("value"), vb, g), g))
        mean = lambda a, b: F.coalesce(F.avg(cosine(F.col(a), F.col(b))), F.lit(0.0))
        per = v.groupBy("layer").agg(F.least(mean("key", "_key"), mean("value", "_value")).alias("c"))
        size = tier_bytes(d, kb, vb, g)
        row = per.agg(F.lit(f"tq-k{kb}v{vb}-g{g}").alias("tier"), F.round(F.min("c"), 5).alias("min_layer_cos"), F.round(F.avg("c"), 5).alias("mean_layer_cos"))
        row = row.withColumns({"bytes_per_token": (F.lit(size) * layers).cast("long"), "x_vs_f16": F.round(F.lit(4 * d / size), 2)})
        out = row if out is None else out.unionByName(row)
    return out


def framed(states: DataFrame, key_bits: int, value_bits: int, group: int) -> DataFrame:
    """blob, payload, refused: the states of a blob (blob, layer, position, key, value) as one tensor payload.

    The payload carries codebook and rotation, so nothing is recomputed to read it. Refused (and null) are blobs whose layers aren't
    0, 1, ... with the same positions, or whose vectors differ in length or don't divide into groups.
    """
    from ..sources import wire

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["layer", "position"])
        counts = rows.groupby("layer")["position"].agg(list)
        dims = {len(x) for c in ("key", "value") for x in rows[c]}
        d = min(dims)
        why = "layers" if list(counts.index) != list(range(len(counts))) else "positions" if any(p != list(range(len(counts.iloc[0]))) for p in counts) else "dims" if len(dims) > 1 or d < 2 else "groups" if d % group else None
        payload = None
        if why is None:
            tensors = {f"cb.{d}.{key_bits}": codebook(d, key_bits).astype(np.float32), f"rot.{d}": rotation(d).astype(np.float32)}
            for layer, part in rows.groupby("layer"):
                words, norm = encode(np.stack(part["key"].to_list()).astype(np.float64), key_bits)
                x = np.stack(part["value"].to_list()).astype(np.float64).reshape(len(part), -1, group)
                low = x.min(2)
                scale = np.maximum((x.max(2) - low) / ((1 << value_bits) - 1), 1e-12)
                q = np.rint((x - low[..., None]) / scale[..., None]).astype(np.int64).reshape(len(part), d)
                tensors |= {f"layers.{layer}.k.idx": words.astype(np.uint32), f"layers.{layer}.k.norm": norm, f"layers.{layer}.v.q": pack(q, value_bits).astype(np.uint32), f"layers.{layer}.v.s": scale.astype(np.float32), f"layers.{layer}.v.b": low.astype(np.float32)}
            payload = wire.encode_tensors(tensors, {"key_bits": str(key_bits), "value_bits": str(value_bits), "group": str(group)})
        return pd.DataFrame({"blob": [key[0]], "payload": [payload], "refused": [why]})

    return states.groupBy("blob").applyInPandas(run, "blob string, payload binary, refused string")


def unframed(frames: DataFrame) -> DataFrame:
    """blob, layer, position, key, value of the payloads of ``framed``; a payload that isn't one fails."""
    from ..sources import wire

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, payload in zip(batch["blob"], batch["payload"]):
                tensors, meta = wire.decode_tensors(bytes(payload))
                kb, vb, group = (int(meta[k]) for k in ("key_bits", "value_bits", "group"))
                turn = next(v for k, v in tensors.items() if k.startswith("rot.")).astype(np.float64)
                d, levels = len(turn), next(v for k, v in tensors.items() if k.startswith("cb.")).astype(np.float64)
                for layer in range(sum(k.endswith(".k.idx") for k in tensors)):
                    t = {n: tensors[f"layers.{layer}.{n}"] for n in ("k.idx", "k.norm", "v.q", "v.s", "v.b")}
                    if t["k.idx"].shape[1] != -(-d // (32 // kb)) or t["v.q"].shape[1] != -(-d // (32 // vb)):
                        raise ValueError(f"{blob}: layer {layer} has codes of another width")
                    keys = levels[unpack(t["k.idx"].astype(np.int64), kb, d)] / np.sqrt(d) @ turn * t["k.norm"][:, None]
                    values = unpack(t["v.q"].astype(np.int64), vb, d).reshape(len(keys), -1, group) * t["v.s"][..., None] + t["v.b"][..., None]
                    out += [(blob, layer, p, k.astype(np.float32), v.astype(np.float32)) for p, (k, v) in enumerate(zip(keys, values.reshape(len(keys), d)))]
            yield pd.DataFrame(out, columns=["blob", "layer", "position", "key", "value"])

    return frames.where("payload IS NOT NULL").select("blob", "payload").mapInPandas(run, "blob string, layer int, position int, key array<float>, value array<float>")


def scored(codes: DataFrame, query: list[float], bits: int) -> DataFrame:
    """``codes`` with score: the dot product with ``query``, taken on the codes (query rotated once)."""
    d = len(query)
    turned, levels = rotation(d) @ np.array(query, np.float64), codebook(d, bits)

    def run(packed: pd.Series, norm: pd.Series) -> pd.Series:
        return pd.Series(levels[unpack(np.stack(packed.to_list()), bits, d)] @ turned * norm.to_numpy() / np.sqrt(d))

    run.__annotations__ = {"packed": pd.Series, "norm": pd.Series, "return": pd.Series}
    return codes.withColumn("score", F.pandas_udf(run, "double")("packed", "norm"))


@functools.cache
def sketch(d: int, seed: int = 13) -> np.ndarray:
    """A seeded Gaussian matrix; signs of residuals hold for this one only."""
    return np.random.default_rng(seed).standard_normal((d, d))


def residual_signs(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of ``x``: signs of the sketched residual that the code leaves, packed to bits, and the residual's length."""
    d = x.shape[1]
    y = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]) @ rotation(d).T * np.sqrt(d)
    levels = codebook(d, bits)
    level = levels[np.searchsorted((levels[1:] + levels[:-1]) / 2, y)]
    left = np.linalg.norm(level, axis=1, keepdims=True) / np.sqrt(d) * y - level
    return np.packbits(left @ sketch(d).T >= 0, axis=1), np.linalg.norm(left, axis=1).astype(np.float32)


def correction(query: np.ndarray, signs: np.ndarray, length: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What the residuals add to the scores of codes with the compensated norms ``norm``, unbiased over sketches."""
    d = len(query)
    bits = np.unpackbits(signs, axis=1, count=d) * 2.0 - 1
    return bits @ (sketch(d) @ (rotation(d) @ query)) * np.sqrt(np.pi / 2) / d * length * norm / np.sqrt(d)


def with_residuals(vectors: DataFrame, column: str, d: int, bits: int) -> DataFrame:
    """``vectors`` with signs (binary) and residual_norm of ``column``, which stays; null for a null vector."""

    def run(x: pd.Series) -> pd.DataFrame:
        ok = x.notna().to_numpy()
        out = pd.DataFrame({"signs": [None] * len(x), "residual_norm": np.full(len(x), np.nan, np.float32)})
        if ok.any():
            signs, length = residual_signs(np.stack(x[ok].to_list()).astype(np.float64), bits)
            out.loc[ok, "signs"] = pd.Series([s.tobytes() for s in signs], index=out.index[ok])
            out.loc[ok, "residual_norm"] = length
        return out

    run.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
    return vectors.select("*", F.pandas_udf(run, "signs binary, residual_norm float")(column).alias("_r")).select(*vectors.columns, "_r.*")


def corrected(scores: DataFrame, query: list[float]) -> DataFrame:
    """``scores`` (score, norm, signs, residual_norm) with the correction added to score."""
    q = np.array(query, np.float64)

    def run(signs: pd.Series, length: pd.Series, norm: pd.Series) -> pd.Series:
        return pd.Series(correction(q, np.stack([np.frombuffer(s, np.uint8) for s in signs]), length.to_numpy(), norm.to_numpy()))

    run.__annotations__ = {"signs": pd.Series, "length": pd.Series, "norm": pd.Series, "return": pd.Series}
    return scores.withColumn("score", F.col("score") + F.pandas_udf(run, "double")("signs", "residual_norm", "norm"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "vec_id").limit(k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, vec_id, score (to 6 decimals): the ``k`` best of ``vectors`` (vec_id, embedding) by dot product; in blocks like ``top_k_each``."""

    def score(v: pd.DataFrame, query: np.ndarray) -> np.ndarray:
        return np.round(np.stack(v["embedding"].to_list()).astype(np.float64) @ query, 6)

    return _blockwise(vectors.where("embedding IS NOT NULL").select("vec_id", "embedding"), queries, score, k, block, query_block)


def top_k_each(codes: DataFrame, queries: DataFrame, d: int, bits: int, k: int, block: int = 8192, query_block: int = 1024, residuals: bool = False) -> DataFrame:
    """query_id, vec_id, score: the ``k`` best of ``codes`` (vec_id, packed, norm) for each of ``queries`` (query_id, embedding); null vectors are left out.

    Blocks of codes meet blocks of queries, so a task holds one of each. ``residuals``: codes have signs and
    residual_norm, whose correction is added.
    """
    columns = ["vec_id", "packed", "norm", *(["signs", "residual_norm"] if residuals else [])]

    def score(c: pd.DataFrame, query: np.ndarray) -> np.ndarray:
        y = codebook(d, bits)[unpack(np.stack(c["packed"].to_list()), bits, d)]
        out = y @ (rotation(d) @ query) * (c["norm"].to_numpy() / np.sqrt(d))
        if residuals:
            out = out + correction(query, np.stack([np.frombuffer(s, np.uint8) for s in c["signs"]]), c["residual_norm"].to_numpy(), c["norm"].to_numpy())
        return out

    return _blockwise(codes.where("packed IS NOT NULL").select(*columns), queries, score, k, block, query_block)


def reranked(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score (to 6 decimals): the ``k`` best of ``found`` (query_id, vec_id) by exact dot product; only found vectors are joined back."""
    j = found.select("query_id", "vec_id").join(vectors.select("vec_id", F.col("embedding").alias("_v")), "vec_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    score = F.round(dot(F.col("_v"), F.col("_q")), 6)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return j.select("query_id", "vec_id", score.alias("score")).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _blockwise(codes: DataFrame, queries: DataFrame, score: Callable[[pd.DataFrame, np.ndarray], np.ndarray], k: int, block: int, query_block: int) -> DataFrame:
    queries = queries.where("embedding IS NOT NULL")
    n, m = -(-codes.count() // block) or 1, -(-queries.count() // query_block) or 1
    numbers = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = codes.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("b"), numbers(m).alias("q"))
    right = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("q"), numbers(n).alias("b"))

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, out = c["vec_id"].to_numpy(), []
        for query, v in zip(q["query_id"], q["embedding"]):
            scores = score(c, np.asarray(v, np.float64))
            best = np.lexsort((ids, -scores))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def group_quantised(values: Column, bits: int, group: int) -> Column:
    """Struct of codes, scales and biases per group of ``group`` values (affine, from minimum to maximum), built in."""
    n = F.ceil(F.size(values) / group).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.slice(values, g * group + 1, F.lit(group)))
    top = (1 << bits) - 1
    scale = lambda p: F.greatest((F.array_max(p) - F.array_min(p)) / top, F.lit(1e-12))
    q = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda v: F.round((v - F.array_min(p)) / scale(p)).cast("long"))))
    return F.struct(q.alias("q"), F.transform(parts, scale).alias("scale"), F.transform(parts, lambda p: F.array_min(p)).alias("bias"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def packed_words(idx: Column, bits: int) -> Column:
    """Built-in form of ``pack`` for one array."""
    per = 32 // bits
    n = F.ceil(F.size(idx) / per).cast("int")
    word = lambda g: F.aggregate(F.transform(F.slice(idx, g * per + 1, F.lit(per)), lambda v, i: v.cast("long") * F.pow(F.lit(2.0), i * bits).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), n - 1), word)
