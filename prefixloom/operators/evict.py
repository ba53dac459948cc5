"""Eviction plans under byte and entry budgets, in one sweep each; anchors and recently used entries stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import materialised


def prefix_sums(df: DataFrame, value: str, order: list[Column], out: str, buckets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before, in ``order``; no task sees all rows.

    Rows are dealt into ranges of the order, as many as the session shuffles into unless ``buckets`` says
    so; sums of ranges give each range's start. With ``by`` (not null) sums start anew at each of its keys,
    and a hot key lies across many ranges.
    """
    ranged, start, inside = _ranged(df, value, order, buckets, by, F.sum)
    return ranged.withColumn(out, F.coalesce(start, F.lit(0)) + F.coalesce(inside, F.lit(0))).drop("_part", "_start")


def prefix_max(df: DataFrame, value: str, order: list[Column], out: str, buckets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Like ``prefix_sums``, the greatest ``value`` before; null without one."""
    ranged, start, inside = _ranged(df, value, order, buckets, by, F.max)
    return ranged.withColumn(out, F.greatest(start, inside)).drop("_part", "_start")


def _ranged(df: DataFrame, value: str, order: list[Column], buckets: int | None, by: tuple[str, ...], fold: Callable) -> tuple[DataFrame, Column, Column]:
    """The rows in ranges, the fold of all ranges before, and that of the rows before within the range."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialised(df.repartitionByRange(buckets, *by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part", *by).agg(fold(value).alias("_s")).withColumn("_start", fold("_s").over(before)).drop("_s")
    inside = fold(value).over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(starts, ["_part", *by]), F.col("_start"), inside


def candidates(entries: DataFrame, now: int, window: int) -> DataFrame:
    """Entries that may go: no structural anchor, not used within the window. Needs is_anchor."""
    return entries.where(~F.col("is_anchor") & (F.lit(now) - F.col("last_used") > window))


def whole_budget(entries: DataFrame, budget: int, now: int, window: int) -> DataFrame:
    """Victims of one sweep over whole blobs: most tokens first, until the total is within ``budget``."""
    total = entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).scalar()
    order = [F.size("tokens").desc(), F.col("name")]
    c = prefix_sums(candidates(entries, now, window), "size_bytes", order, "freed_before")
    return c.where(total - F.col("freed_before") > budget).select("name", "size_bytes", F.col("freed_before").cast("long"))


def chunk_budget(entries: DataFrame, chunks: DataFrame, budget: int, now: int, window: int) -> DataFrame:
    """Victims of one sweep over a chunk store: ``chunks`` (name, digest, size), a row per use.

    A chunk goes with the last of its holders: its death rank is the greatest rank among them, and it
    never dies if one of them can't go. Candidates stand by bytes that only they hold, most first.
    """
    uses = chunks.select("name", "digest", "size").distinct()
    holders = uses.groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    unique = uses.join(holders.where("n = 1").select("digest"), "digest").groupBy("name").agg(F.sum("size").alias("unique_bytes"))
    c = candidates(entries, now, window).join(unique, "name", "left").withColumn("unique_bytes", F.coalesce("unique_bytes", F.lit(0)).cast("long"))
    order = [F.col("unique_bytes").desc(), F.col("name")]
    rank = prefix_sums(c.select("name", "unique_bytes").withColumn("_one", F.lit(1)), "_one", order, "rank").select("name", "unique_bytes", F.col("rank").cast("long").alias("rank"))
    deaths = uses.join(rank, "name", "left").groupBy("digest").agg(F.max("rank").alias("d"), F.max(F.col("rank").isNull()).alias("_held"), F.max("size").alias("size")).where("NOT _held")
    by_rank = deaths.groupBy(F.col("d").alias("rank")).agg(F.sum("size").alias("frees"))
    total = holders.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    freed = prefix_sums(rank.join(by_rank, "rank", "left").withColumn("frees", F.coalesce("frees", F.lit(0))), "frees", [F.col("rank")], "freed_before")
    return freed.where(total - F.col("freed_before") > budget).select("name", "unique_bytes", "rank", F.col("freed_before").cast("long").alias("freed_before"))


def entry_cap(entries: DataFrame, cap: int, now: int, window: int) -> DataFrame:
    """Victims so that at most ``cap`` entries stay (0: no cap), as far as candidates go."""
    over = entries.agg(F.count("*")).scalar() - cap
    c = prefix_sums(candidates(entries, now, window).withColumn("_one", F.lit(1)), "_one", [F.size("tokens").desc(), F.col("name")], "rank")
    return c.where((F.lit(cap) > 0) & (F.col("rank") < over)).select("name", F.col("rank").cast("long").alias("rank"))
