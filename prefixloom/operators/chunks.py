"""Chunked dedup store as tables: block digests, references, sharing, fragmentation, compaction, chunkers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

RECORD_HEADER, SEGMENT_HEADER = 36, 8
CHUNKS = StructType([StructField("end_off", LongType()), StructField("size", LongType()), StructField("digest", StringType())])


def fixed_blocks(blobs: DataFrame, block: int, payload: str = "payload") -> DataFrame:
    """A row per block of ``block`` bytes: chunk_no, size, digest (sha-256); empty payloads have none."""
    n = F.octet_length(payload)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = blobs.withColumn("chunk_no", F.explode(at))
    body = F.substring(F.col(payload).cast("binary"), F.col("chunk_no") * block + 1, F.lit(block))
    return rows.withColumn("size", F.octet_length(body).cast("long")).withColumn("digest", F.sha2(body, 256)).drop(payload)


def block_lists(blobs: DataFrame, block: int, payload: str = "payload") -> DataFrame:
    """A row per blob that is not empty: size, and c, its different blocks (digest, size) in order of digest.

    Made within the row: no block is sent, and the payload, a variable of the outer lambda, is not copied for each block.
    """
    kept = [c for c in blobs.columns if c != payload]

    def blocks(p: Column) -> Column:
        body = lambda i: F.substring(p, (i * block + 1).cast("int"), F.lit(block))
        # Strings, since arrays of structs are made distinct in quadratic time.
        return F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(p) - 1) / block).cast("int")), lambda i: F.concat(F.sha2(body(i), 256), F.octet_length(body(i)).cast("string")))

    texts = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(F.col(payload).cast("binary")), blocks))))
    c = F.transform(texts, lambda t: F.struct(F.substring(t, 1, 64).alias("digest"), F.substring(t, 65, 20).cast("long").alias("size")))
    rows = blobs.where(F.octet_length(payload) > 0)
    return rows.select(*kept, F.octet_length(payload).cast("long").alias("size"), c.alias("c"))


def gear_table() -> np.ndarray:
    """256 words of splitmix64."""
    out, x, mask = [], 0x9E3779B97F4A7C15, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64)


def envelope(average: int) -> tuple[int, int, int]:
    """Least and greatest chunk size and the mask's bits of an average."""
    return average // 4, average * 4, max(8, average.bit_length() - 1)


def cut(data: bytes, average: int, gear: np.ndarray) -> list[int]:
    """Ends of content-defined chunks: a rolling gear hash over 64 bytes, masked, within the envelope."""
    least, most, bits = envelope(average)
    values = gear[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(values), np.uint64)
    for k in range(min(64, len(values))):  # the hash at a place is the sum of shifted words of the last 64 bytes
        h[k:] += values[: len(values) - k] << np.uint64(k)
    spots = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
    ends, start = [], 0
    while start < len(data):
        i = np.searchsorted(spots, start + max(least, 1))
        end = min(start + most, len(data))
        if i < len(spots) and spots[i] <= end:
            end = int(spots[i])
        ends.append(end)
        start = end
    return ends


def content_defined(blobs: DataFrame, average: int, payload: str = "payload") -> DataFrame:
    """A row per content-defined chunk: end_off, size, digest."""
    gear = gear_table()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for data in batch:
                data = bytes(data or b"")
                ends = cut(data, average, gear)
                out.append([(e, e - s, hashlib.sha256(data[s:e]).hexdigest()) for s, e in zip([0, *ends], ends)])
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, ArrayType(CHUNKS))
    kept = [c for c in blobs.columns if c != payload]
    return blobs.select(*kept, F.posexplode(udf(F.col(payload).cast("binary"))).alias("chunk_no", "c")).select(*kept, "chunk_no", "c.*")


def refcounts(chunks: DataFrame) -> DataFrame:
    """Uses of each digest, repeats within a blob included, and the blobs that use it."""
    return chunks.groupBy("digest").agg(F.count("*").alias("refs"), F.count_distinct("blob").alias("blobs"), F.max("size").alias("size"))


def share_store(chunks: DataFrame) -> DataFrame:
    """One row: live and shared chunks, record bytes held once or by several blobs, logical bytes, dedup ratio (logical over live record bytes, headers included)."""
    r = refcounts(chunks)
    record = F.col("size") + RECORD_HEADER
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return r.agg(
        F.count("*").alias("chunks_live"), F.count_if(F.col("blobs") > 1).alias("chunks_shared"),
        total(F.when(F.col("blobs") == 1, record)).alias("unique_bytes"), total(F.when(F.col("blobs") > 1, record)).alias("shared_bytes"),
        total(F.col("refs") * F.col("size")).alias("logical_bytes"),
        F.round(F.coalesce(F.sum(F.col("refs") * F.col("size")) / F.nullif(F.sum(record), F.lit(0)), F.lit(0.0)), 4).alias("dedup_ratio"),
    )


def share_blobs(chunks: DataFrame) -> DataFrame:
    """By blob: record bytes of its different chunks that it holds alone, and shares."""
    own = chunks.select("blob", "digest").distinct().join(refcounts(chunks), "digest")
    record = F.col("size") + RECORD_HEADER
    part = lambda c, name: F.coalesce(F.sum(F.when(c, record)), F.lit(0)).cast("long").alias(name)
    return own.groupBy("blob").agg(part(F.col("blobs") == 1, "unique_bytes"), part(F.col("blobs") > 1, "shared_bytes"))


def new_bytes_per_turn(chunks: DataFrame, by: tuple[str, ...] = ("convo",)) -> DataFrame:
    """By ``by`` and turn: bytes of chunks unseen in earlier turns (repeats within the turn count), payload bytes, new share. The chunks are made and sent once."""
    rows = chunks.select(*by, "turn", "digest", "size").dropna(subset=[*by, "digest"])
    j = rows.withColumn("_first", F.min("turn").over(Window.partitionBy(*by, "digest")))
    g = j.groupBy(*by, "turn").agg(F.coalesce(F.sum(F.when(F.col("turn") == F.col("_first"), F.col("size"))), F.lit(0)).cast("long").alias("new_bytes"), F.sum("size").cast("long").alias("payload_bytes"))
    return g.withColumn("new_frac", F.round(F.col("new_bytes") / F.col("payload_bytes"), 4))


def mean_new_frac(per_turn: DataFrame, by: tuple[str, ...] = ("convo",)) -> DataFrame:
    """By ``by`` with two turns or more: the ratio of sums over all turns but the first, and the unique bytes."""
    every = Window.partitionBy(*by)
    j = per_turn.dropna(subset=[*by]).withColumns({"_t": F.min("turn").over(every), "turns": F.count("*").over(every)})
    late = lambda c: F.sum(F.when(F.col("turn") > F.col("_t"), F.col(c)))
    return j.where("turns >= 2").groupBy(*by).agg(F.max("turns").alias("turns"), F.round(late("new_bytes") / late("payload_bytes"), 4).alias("mean_new_frac"), F.sum("new_bytes").cast("long").alias("unique_bytes"))


def stability(chunks: DataFrame, stream: tuple[str, ...] = ("convo",)) -> DataFrame:
    """One row: of the cuts of each turn below its length, how many come again in the next turn below the shared length; by ``stream`` (a head's, say)."""
    keys = [*stream, "turn"]
    length = chunks.groupBy(*keys).agg(F.max("end_off").alias("_n"))
    first = chunks.groupBy(*keys).agg(F.min(F.col("end_off") - F.col("size")).alias("_b"))
    own = chunks.join(length.join(first, keys), keys).select(*keys, (F.col("end_off") - F.col("_b")).alias("_cut"), (F.col("_n") - F.col("_b")).alias("_len"))
    cuts = own.where("_cut < _len")
    later = cuts.select(*stream, (F.col("turn") - 1).alias("turn"), "_cut").distinct().withColumn("_again", F.lit(1))
    follows = length.join(first, keys).select(*stream, (F.col("turn") - 1).alias("turn"), (F.col("_n") - F.col("_b")).alias("_next"))
    j = cuts.join(follows, keys).join(later, [*keys, "_cut"], "left")
    again = F.count_if(F.col("_again").isNotNull() & (F.col("_cut") < F.least("_len", "_next")))
    return j.agg(F.count("*").alias("cuts"), again.alias("stable"), F.round(F.coalesce(again / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 4).alias("stability"))


def placements(records: DataFrame) -> DataFrame:
    """``records`` (seg, rec_off, body_len, digest) with placed: the copy that counts, in the newest segment, first there."""
    best = records.groupBy("digest").agg(F.max(F.struct("seg", (-F.col("rec_off")).alias("o"))).alias("_b"))
    return records.join(best, "digest").withColumn("placed", (F.col("_b.seg") == F.col("seg")) & (-F.col("_b.o") == F.col("rec_off"))).drop("_b")


def segment_stats(records: DataFrame, live: DataFrame) -> DataFrame:
    """By segment: record bytes, dead bytes (unreferenced, or a lost copy), live records."""
    p = placements(records).join(live.select("digest").distinct().withColumn("_live", F.lit(True)), "digest", "left")
    alive, size = F.coalesce("_live", F.lit(False)) & F.col("placed"), F.col("body_len") + RECORD_HEADER
    return p.groupBy("seg").agg(F.sum(size).cast("long").alias("total"), F.coalesce(F.sum(F.when(~alive, size)), F.lit(0)).cast("long").alias("dead"), F.count_if(alive).alias("live_records"))


def fragmentation(stats: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return stats.agg(total("total"), total("dead"), F.count_if((F.col("dead") > 0) & (F.col("live_records") > 0)).alias("partly_dead"), F.count_if(F.col("live_records") == 0).alias("empty_segments"))


def compaction_plan(stats: DataFrame, active: int, ratio: float, least_dead: int, most_segments: int) -> DataFrame:
    """The segments to rewrite, most dead bytes first, and what each gives back."""
    c = stats.where((F.col("seg") != active) & (F.col("live_records") > 0) & (F.col("dead") > 0) & (F.col("dead") >= least_dead) & (F.col("dead") >= ratio * F.col("total")))
    return c.orderBy(F.desc("dead"), "seg").limit(most_segments).select("seg", "total", "dead", (F.col("total") - F.col("dead") + SEGMENT_HEADER).cast("long").alias("new_bytes"))


def packed_offsets(records: DataFrame, segment: str = "seg") -> DataFrame:
    """Offsets of live records in a rewritten segment, in order of digest. A segment's records are one task's: its target size bounds them."""
    ahead = F.sum(F.col("body_len") + RECORD_HEADER).over(Window.partitionBy(segment).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("new_off", (F.coalesce(ahead, F.lit(0)) + SEGMENT_HEADER).cast("long"))


def gaps(spans: DataFrame) -> DataFrame:
    """Bytes between consecutive spans (blob, start, end) and before the first. A blob's spans (numbers) are one task's: its size bounds them."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy("blob").orderBy("start", "end")), F.lit(0))
    return spans.select("blob", before.cast("long").alias("gap_start"), F.col("start").cast("long").alias("gap_end")).where("gap_end > gap_start")


def overlaps(spans: DataFrame) -> DataFrame:
    later = F.lead("start").over(Window.partitionBy("blob").orderBy("start", "end"))
    return spans.withColumn("next_start", later).where("next_start < end")


def containment(a: DataFrame, b: DataFrame, key: str = "pair", digest: str = "digest") -> DataFrame:
    """By ``key``: the share of a's blocks (repeats count) found in b, and of b's different blocks found in a."""
    mark = lambda df: df.select(key, digest).distinct()
    x = a.join(mark(b).withColumn("_in", F.lit(1)), [key, digest], "left").groupBy(key).agg(F.round(F.count("_in") / F.count("*"), 4).alias("a_in_b"))
    y = mark(b).join(mark(a).withColumn("_in", F.lit(1)), [key, digest], "left").groupBy(key).agg(F.round(F.count("_in") / F.count("*"), 4).alias("b_in_a"))
    return x.join(y, key)


def reassembled(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """blob, payload: bodies joined by digest, put together in order; a missing body makes the payload null."""
    j = manifest.select("blob", "chunk_no", "digest").join(bodies.select("digest", "body").dropDuplicates(["digest"]), "digest", "left")
    g = j.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("chunk_no", F.hex("body").alias("h")))).alias("c"), F.count_if(F.col("body").isNull()).alias("_lost"))
    return g.select("blob", F.when(F.col("_lost") == 0, F.unhex(F.array_join("c.h", ""))).alias("payload"))


def block_width(d: Column, bits: int) -> Column:
    """Words of 32 bits that hold ``d`` values of ``bits`` bits, none across two words."""
    return F.ceil(d / (32 // bits)).cast("long")
