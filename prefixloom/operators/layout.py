"""Chunks over head-major tensor payloads: blocks of positions, segments by file, tensor or head, and their reassembly.

A payload holds tensors (``spans``: tensor, begin, end, n_heads; absolute offsets), each head's bytes one
after the other, each position's bytes one after the other in a head. A block of positions is not
contiguous: its bytes are the heads' slices put together, and so is its digest. All of it is built in;
slices are cut inside a row, so a payload is never copied per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_BLOCK = 64
REF = "array<struct<tensor:string,digest:string,size:bigint,per_head_len:bigint,n_heads:bigint,first_off:bigint,head_stride:bigint>>"


def _bytes(payload: Column, start: Column, n: Column) -> Column:
    return F.substring(payload, (start + 1).cast("int"), n.cast("int"))


def _ref(tensor: Column, body: Column, size: Column, per_head: Column, heads: Column, first: Column, stride: Column) -> Column:
    long = lambda c: c.cast("bigint")
    return F.struct(
        tensor.alias("tensor"), F.sha2(body, 256).alias("digest"), long(size).alias("size"), long(per_head).alias("per_head_len"), long(heads).alias("n_heads"),
        long(first).alias("first_off"), long(stride).alias("head_stride"),
    )


def head_slices(payload: Column, begin: Column, stride: Column, heads: Column, offset: Column, n: Column) -> Column:
    """The ``n`` bytes from ``offset`` of every head, put together."""
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), heads.cast("bigint") - 1), F.lit(b""), lambda acc, h: F.concat(acc, _bytes(payload, begin + h * stride + offset, n)))


def _whole(payload: Column, tensor: Column, begin: Column, end: Column) -> Column:
    return _ref(tensor, _bytes(payload, begin, end - begin), end - begin, end - begin, F.lit(1), begin, F.lit(0))


def uncovered(spans: Column, length: Column) -> Column:
    """Ranges (begin, end) of a payload that no span covers."""
    ranges = F.array_sort(F.transform(F.filter(spans, lambda t: t["end"] > t["begin"]), lambda t: F.struct(t["begin"].cast("bigint").alias("begin"), t["end"].cast("bigint").alias("end"))))
    end = F.struct(length.cast("bigint").alias("begin"), length.cast("bigint").alias("end"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("gaps"))

    def step(s: Column, r: Column) -> Column:
        gap = F.when(r["begin"] > s["at"], F.array(F.struct(s["at"].alias("begin"), r["begin"].alias("end")))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))
        return F.struct(F.greatest(s["at"], r["end"]).alias("at"), F.concat(s["gaps"], gap).alias("gaps"))

    return F.aggregate(F.concat(ranges, F.array(end)), start, step, lambda s: s["gaps"])


def token_blocks(blobs: DataFrame, block: int = TOKEN_BLOCK, ragged: str = "whole") -> DataFrame:
    """A row per chunk of ``blobs`` (payload, positions, spans): chunk_no, tensor, digest, size, per_head_len, n_heads, first_off, head_stride.

    Tensors by name, each in blocks of ``block`` positions; a tensor whose heads don't divide by the positions
    is one chunk (``ragged="fail"``: an error), bytes of no tensor (headers, gaps) one chunk per range, after
    the tensors. A payload without spans (null) or positions is one chunk, an empty one has none.
    """
    if ragged not in ("whole", "fail"):
        raise ValueError(f"ragged is whole or fail, not {ragged}")
    kept = [c for c in blobs.columns if c not in ("payload", "positions", "spans")]
    p, n = F.col("payload"), F.col("positions")
    none = F.array().cast(REF)

    def of(t: Column) -> Column:
        length, heads = t["end"] - t["begin"], F.greatest(t["n_heads"], F.lit(1))
        stride = F.floor(length / heads)
        exact = (stride * heads == length) & (stride % n == 0)
        unit = F.floor(stride / n)

        def one(b: Column) -> Column:
            first, m = b * block, F.least(F.lit(block).cast("bigint"), n - b * block)
            body = head_slices(p, t["begin"], stride, heads, first * unit, m * unit)
            return _ref(t["tensor"], body, m * unit * heads, m * unit, heads, t["begin"] + first * unit, stride)

        blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block)), one)
        rest = F.array(_whole(p, t["tensor"], t["begin"], t["end"]))
        if ragged == "fail":
            rest = F.raise_error(F.concat(F.lit("tensor "), t["tensor"], F.lit(" does not divide by the positions"))).cast(REF)
        return F.when(exact, blocks).otherwise(rest)

    own = F.array_sort(F.transform(F.filter("spans", lambda t: t["end"] > t["begin"]), lambda t: F.struct(t["tensor"].alias("tensor"), t["begin"].cast("bigint").alias("begin"), t["end"].cast("bigint").alias("end"), t["n_heads"].cast("bigint").alias("n_heads"))))
    rest = F.transform(uncovered(F.col("spans"), F.octet_length(p)), lambda r: _whole(p, F.lit(None).cast("string"), r["begin"], r["end"]))
    whole = F.when(F.octet_length(p) > 0, F.array(_whole(p, F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.octet_length(p).cast("bigint")))).otherwise(none)
    refs = F.when(F.col("spans").isNull() | F.coalesce(n < 1, F.lit(True)), whole).otherwise(F.concat(F.flatten(F.transform(own, of)), rest))
    cut = blobs.withColumns({"payload": p.cast("binary"), "positions": n.cast("bigint")}).select(*kept, refs.alias("_r"))
    # The outer form: Spark filters empty arrays before an inner one, and would compute them again for that.
    return cut.select(*kept, F.posexplode_outer("_r").alias("chunk_no", "c")).where("c IS NOT NULL").select(*kept, "chunk_no", "c.*")


def scopes(blobs: DataFrame, scope: str) -> DataFrame:
    """The stretches that a chunker may not cut across: the ``file``, each ``tensor``, or each ``head``; tensor, head, begin, payload (the stretch)."""
    kept = [c for c in blobs.columns if c not in ("payload", "positions", "spans")]
    p = F.col("payload").cast("binary")
    if scope == "file":
        return blobs.select(*kept, F.lit(None).cast("string").alias("tensor"), F.lit(0).alias("head"), F.lit(0).cast("bigint").alias("begin"), p.alias("payload"))
    if scope not in ("tensor", "head"):
        raise ValueError(f"scope is file, tensor or head, not {scope}")

    def of(t: Column) -> Column:
        heads = F.lit(1).cast("bigint") if scope == "tensor" else F.greatest(t["n_heads"], F.lit(1)).cast("bigint")
        width = F.floor((t["end"] - t["begin"]) / heads)
        return F.transform(F.sequence(F.lit(0).cast("bigint"), heads - 1), lambda h: F.struct(t["tensor"].alias("tensor"), h.cast("int").alias("head"), (t["begin"] + h * width).cast("bigint").alias("begin"), _bytes(p, t["begin"] + h * width, width).alias("payload")))

    return blobs.select(*kept, F.explode_outer(F.flatten(F.transform("spans", of))).alias("s")).where("s IS NOT NULL").select(*kept, "s.*")


def scoped(blobs: DataFrame, scope: str, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``chunker`` (rows with payload to rows with end_off, size, digest) over each stretch; end_off counts from the payload's start."""
    out = chunker(scopes(blobs, scope))
    return out.withColumn("end_off", F.col("begin") + F.col("end_off")).drop("begin")


def scattered(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """blob, payload: the chunks of ``manifest`` (blob, digest, per_head_len, n_heads, first_off, head_stride, payload_len) put where they belong.

    Every head's slice goes to its own place, in order of destination; ranges that no chunk covers are zeros. A missing or
    short body, or one written over another, makes the payload null. A payload is one value of the result, and as long.
    """
    j = manifest.join(bodies.select("digest", "body").dropDuplicates(["digest"]), "digest", "left")
    lost = F.coalesce(F.octet_length("body") != F.col("per_head_len") * F.col("n_heads"), F.lit(True))
    j = j.withColumn("_lost", lost).withColumn("_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_heads") - 1)))
    part = F.struct((F.col("first_off") + F.col("_h") * F.col("head_stride")).alias("at"), F.hex(_bytes(F.col("body"), F.col("_h") * F.col("per_head_len"), F.col("per_head_len"))).alias("x"))
    g = j.groupBy("blob").agg(F.array_sort(F.collect_list(part)).alias("p"), F.max("payload_len").alias("n"), F.max("_lost").alias("lost"))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("p", lambda x: (x["at"] + F.length(x["x"]) / 2).cast("bigint")))
    g = g.withColumn("e", ends)
    filled = F.transform("p", lambda x, i: F.concat(F.repeat(F.lit("00"), F.greatest(x["at"] - F.get("e", i), F.lit(0)).cast("int")), x["x"]))
    over = F.exists(F.arrays_zip(F.col("p.at").alias("a"), F.slice("e", 1, F.size("p")).alias("b")), lambda z: z["a"] < z["b"])
    tail = F.repeat(F.lit("00"), F.greatest(F.col("n") - F.element_at("e", -1), F.lit(0)).cast("int"))
    bad = F.col("lost") | over | (F.element_at("e", -1) > F.col("n"))
    return g.select("blob", F.when(~bad, F.unhex(F.concat(F.array_join(filled, ""), tail))).alias("payload"))


def round_trip(blobs: DataFrame, block: int = TOKEN_BLOCK) -> DataFrame:
    """blob, bytes, chunks, bytes_per_position, same: payloads cut into blocks and put together again, byte for byte."""
    refs = token_blocks(blobs, block)
    heads = F.sequence(F.lit(0).cast("bigint"), F.col("n_heads") - 1)
    slices = F.transform(heads, lambda h: _bytes(F.col("payload"), F.col("first_off") + h * F.col("head_stride"), F.col("per_head_len")))
    own = blobs.select("blob", "positions", F.col("payload").cast("binary").alias("payload"))
    j = refs.join(own, "blob")
    bodies = j.select("digest", F.aggregate(slices, F.lit(b""), lambda a, x: F.concat(a, x)).alias("body"))
    manifest = refs.join(own.select("blob", F.octet_length("payload").cast("bigint").alias("payload_len")), "blob")
    back = scattered(manifest, bodies).select("blob", F.sha2("payload", 256).alias("_back"))
    counts = refs.groupBy("blob").agg(F.count("*").alias("chunks"))
    out = own.join(back, "blob", "left").join(counts, "blob", "left")
    n = F.octet_length("payload").cast("bigint")
    same = F.when(n == 0, True).otherwise(F.coalesce(F.sha2("payload", 256) == F.col("_back"), F.lit(False)))
    return out.select("blob", n.alias("bytes"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.round(n / F.greatest("positions", F.lit(1)), 2).alias("bytes_per_position"), same.alias("same"))
