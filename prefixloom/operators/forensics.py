"""Byte forensics of payload pairs, and chunk lists laid out in rolling segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bytes compared at once.
_PIECE = 1 << 20


def first_difference(a: bytes | None, b: bytes | None) -> int | None:
    """Offset of the first byte that differs within the shorter one; None if there is none or one is null."""
    if a is None or b is None:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    for at in range(0, min(len(x), len(y)), _PIECE):
        n = min(_PIECE, len(x) - at, len(y) - at)
        if (apart := x[at : at + n] != y[at : at + n]).any():
            return at + int(apart.argmax())
    return None


@F.pandas_udf(LongType())
def first_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([first_difference(x, y) for x, y in zip(a, b)], dtype="Int64")


def heads_compared(pairs: DataFrame, positions: Column) -> DataFrame:
    """A row per head of each pair (pair, tensor, a, b, n_heads): head, leading_equal, first_diff_byte and first_diff_position.

    Each head of ``a`` is held against the leading bytes of the same head of ``b``, at its own offset: when a sequence
    grows, later heads move. ``positions`` is the number of positions that ``a`` covers.
    """
    width = lambda c: F.floor(F.octet_length(c) / F.col("n_heads")).cast("int")
    rows = pairs.withColumns({"_wa": width("a"), "_wb": width("b"), "_unit": F.greatest(F.floor(width("a") / positions), F.lit(1))})
    rows = rows.withColumn("head", F.explode(F.sequence(F.lit(0), F.col("n_heads").cast("int") - 1)))
    part = lambda c, w: F.substring(F.col(c).cast("binary"), F.col("head") * F.col(w) + 1, F.least("_wa", w))
    cut = rows.select("pair", "tensor", "head", "_unit", first_diff(part("a", "_wa"), part("b", "_wb")).alias("first_diff_byte"))
    at = F.floor(F.col("first_diff_byte") / F.col("_unit")).cast("long")
    return cut.select("pair", "tensor", "head", F.col("first_diff_byte").isNull().alias("leading_equal"), "first_diff_byte", at.alias("first_diff_position"))


def heads_exact(heads: DataFrame) -> DataFrame:
    return heads.groupBy("pair", "tensor").agg(F.count("*").alias("n_heads"), F.count_if("leading_equal").alias("heads_equal"))


def layout(tensors: DataFrame, positions: Column) -> DataFrame:
    """By tensor name over all blobs: the range of bytes a position and the remainders that don't divide."""
    n = F.col("end") - F.col("begin")
    return tensors.groupBy("tensor").agg(F.min(F.floor(n / positions)).alias("least"), F.max(F.floor(n / positions)).alias("most"), F.sort_array(F.collect_set(n % positions)).alias("remainders"))


def rolled(chunks: DataFrame, segment_bytes: int, per: str = "blob") -> DataFrame:
    """``chunks`` (``per``, end_off, size) with seg and seg_off: filled in order of end_off, a new segment where the next chunk won't fit.

    The fill is greedy, so it is one pass over a blob's chunks, held as two columns of numbers in one task each.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["end_off", "size"]).reset_index(drop=True)
        seg, used, placed = 0, 0, []
        for size in rows["size"]:
            if used and used + size > segment_bytes:
                seg, used = seg + 1, 0
            placed.append((seg, used))
            used += size
        return rows.assign(seg=[p[0] for p in placed], seg_off=[p[1] for p in placed])

    schema = f"{per} {chunks.schema[per].dataType.simpleString()}, end_off long, size long, seg long, seg_off long"
    return chunks.select(per, F.col("end_off").cast("long"), F.col("size").cast("long")).groupBy(per).applyInPandas(run, schema)


def worker_groups(items: DataFrame, workers: int, per: str, order: str, size: str = "size") -> DataFrame:
    """``items`` with worker: consecutive items, near-equal bytes a worker."""
    w = Window.partitionBy(per)
    ahead = F.coalesce(F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("worker", F.least(F.floor(ahead * workers / F.greatest(F.sum(size).over(w), F.lit(1))), F.lit(workers - 1)).cast("long"))


def materialised(chunks: DataFrame, lengths: DataFrame, segment_bytes: int | None, per: str = "blob") -> tuple[DataFrame, DataFrame]:
    """Where the chunks of payloads lie (``per``, start, size, seg, seg_off), and the spans kept inline: bytes that no chunk covers (``per``, gap_start, gap_end).

    ``chunks``: ``per``, end_off, size. ``segment_bytes``: packed into segments of that size; None: a file for each chunk.
    ``lengths``: ``per``, payload_len.
    """
    if segment_bytes is None:
        order = Window.partitionBy(per).orderBy("end_off", "size")
        placed = chunks.select(per, F.col("end_off").cast("long"), F.col("size").cast("long")).withColumns({"seg": (F.row_number().over(order) - 1).cast("long"), "seg_off": F.lit(0).cast("long")})
    else:
        placed = rolled(chunks, segment_bytes, per)
    placed = placed.select(per, (F.col("end_off") - F.col("size")).alias("start"), "size", "seg", "seg_off")
    spans = placed.select(per, "start", (F.col("start") + F.col("size")).alias("end")).unionByName(lengths.select(per, F.col("payload_len").cast("long").alias("start"), F.col("payload_len").cast("long").alias("end")))
    before = F.coalesce(F.max("end").over(Window.partitionBy(per).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inline = spans.select(per, before.cast("long").alias("gap_start"), F.col("start").alias("gap_end")).where("gap_end > gap_start")
    return placed, inline
