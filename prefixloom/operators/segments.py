"""Mutations of a chunk store as whole-table transforms: staging, collection, compaction, sweeps, sizes.

``records``: seg, rec_off, body_len, digest (and body, where bodies are held); ``live``: the digests that live
manifests refer to. References are derived from manifests each time and never stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunks
from .chunks import RECORD_HEADER, SEGMENT_HEADER
from .evict import prefix_sums


@dataclass(frozen=True)
class CompactConfig:
    """When a segment is rewritten. ``parsed`` reads settings by name; a value that can't be read leaves its default."""

    enabled: bool = True
    ratio: float = 0.5
    min_dead_bytes: int = 16 << 20
    max_segments: int = 2

    @classmethod
    def parsed(cls, settings: dict[str, str]) -> CompactConfig:
        def number(name: str, kind: type, default, least, most):
            try:
                value = kind(settings.get(name, default))
            except ValueError:
                return default
            return value if least <= value <= most else default

        top = 1 << 64
        return cls(
            settings.get("enabled") not in ("0", "false"), number("ratio", float, cls.ratio, 0.0, 1.0),
            number("min_dead_bytes", int, cls.min_dead_bytes, 0, top), number("max_segments", int, cls.max_segments, 0, top),
        )


@dataclass(frozen=True)
class EvictConfig:
    """Limits of a sweep; none of them: nothing is evicted. No entries means no cap on entries."""

    max_entries: int | None = None
    max_bytes: int | None = None
    max_quarantined: int | None = None
    anchor_window_s: int = 900

    @classmethod
    def parsed(cls, max_entries: int = 0, max_bytes: int = 0, max_quarantined: int | None = None, anchor_window_s: int = 900) -> EvictConfig:
        return cls(max_entries or None, max_bytes or None, max_quarantined, anchor_window_s)

    @property
    def enabled(self) -> bool:
        return any(x is not None for x in (self.max_entries, self.max_bytes, self.max_quarantined))


def staged(records: DataFrame, new: DataFrame, target: int, active: int | None = None) -> DataFrame:
    """The records that ``new`` (digest, body_len) adds to ``records``: each digest that isn't there, once.

    They fill segments in order of digest from after the ``active`` one, each up to ``target`` bytes: a record that
    begins within a segment's share is its record. Places are prefix sums, so no task sees all.
    """
    fresh = new.groupBy("digest").agg(F.max("body_len").cast("long").alias("body_len")).join(records.select("digest").distinct(), "digest", "left_anti")
    size = F.col("body_len") + RECORD_HEADER
    placed = prefix_sums(fresh.withColumn("_size", size), "_size", [F.col("digest")], "_at").withColumn("_seg", F.floor(F.col("_at") / (target - SEGMENT_HEADER)).cast("long"))
    first = placed.groupBy("_seg").agg(F.min("_at").alias("_first"))
    out = placed.join(first, "_seg")
    return out.select((F.col("_seg") + F.lit((active or 0) + 1)).alias("seg"), (F.col("_at") - F.col("_first") + SEGMENT_HEADER).cast("long").alias("rec_off"), "body_len", "digest")


def live_digests(manifests: DataFrame, live_blobs: DataFrame) -> DataFrame:
    """digest, refs: uses by manifests (blob, digest) of live blobs, repeats included. Registering or unregistering a blob changes ``live_blobs``."""
    return manifests.join(live_blobs.select("blob").distinct(), "blob", "left_semi").groupBy("digest").agg(F.count("*").alias("refs"))


def collected(records: DataFrame, live: DataFrame, active: int | None) -> tuple[DataFrame, DataFrame]:
    """``records`` without the segments that hold no live record (never the active one), and a row per segment dropped: seg, reclaimed."""
    stats = chunks.segment_stats(records, live)
    gone = stats.where((F.col("live_records") == 0) & ~F.col("seg").eqNullSafe(F.lit(active))).select("seg", F.col("total").alias("reclaimed"))
    return records.join(gone.select("seg"), "seg", "left_anti").select(*records.columns), gone


def compacted(records: DataFrame, live: DataFrame, active: int | None, config: CompactConfig = CompactConfig()) -> tuple[DataFrame, DataFrame]:
    """``records`` with the worst segments rewritten, and a receipt per segment: seg, new_seg, moved, reclaimed.

    A rewritten segment's live records move to a new segment, packed in order of their offsets (at the same offset, of
    digests); its dead records and lost copies leave. New segments are numbered from after the last, worst first.
    """
    stats = chunks.segment_stats(records, live)
    plan = chunks.compaction_plan(stats, -1 if active is None else active, config.ratio, config.min_dead_bytes, config.max_segments if config.enabled else 0)
    last = records.agg(F.coalesce(F.max("seg"), F.lit(0))).scalar()
    # The plan is a top-k of at most max_segments rows: one window is enough.
    plan = plan.select("seg", "total", (last + F.row_number().over(Window.orderBy(F.desc("dead"), "seg"))).cast("long").alias("new_seg"))
    moving = chunks.placements(records).where("placed").drop("placed").join(live.select("digest").distinct(), "digest", "left_semi").join(plan, "seg")
    ahead = F.sum(F.col("body_len") + RECORD_HEADER).over(Window.partitionBy("seg").orderBy("rec_off", "digest").rowsBetween(Window.unboundedPreceding, -1))
    moved = moving.withColumn("_off", (F.coalesce(ahead, F.lit(0)) + SEGMENT_HEADER).cast("long"))
    kept = records.join(plan.select("seg"), "seg", "left_anti").select(*records.columns)
    new = moved.withColumns({"rec_off": F.col("_off"), "seg": F.col("new_seg")}).select(*records.columns)
    receipts = moved.groupBy("seg", "new_seg", "total").agg(F.count("*").alias("moved"), F.sum(F.col("body_len") + RECORD_HEADER).alias("_bytes"))
    return kept.unionByName(new), receipts.select("seg", "new_seg", "moved", (F.col("total") - F.col("_bytes")).cast("long").alias("reclaimed"))


def swept(records: DataFrame, live: DataFrame, config: CompactConfig = CompactConfig()) -> tuple[DataFrame, DataFrame]:
    """A manual sweep: the active segment is sealed, so every segment may be rewritten or dropped. A receipt of one row: segments, reclaimed, collected."""
    after, receipts = compacted(records, live, None, config)
    after, gone = collected(after, live, None)
    zero = F.lit(0).cast("long")
    parts = receipts.select(F.lit(1).alias("segments"), "reclaimed", zero.alias("collected")).unionByName(gone.select(F.lit(0).alias("segments"), zero.alias("reclaimed"), F.col("reclaimed").alias("collected")))
    receipt = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("segments", "reclaimed", "collected")])
    return after, receipt


def gross_bytes(manifests: DataFrame) -> DataFrame:
    """By blob: bytes of all its references, repeats counted (body_len of each is ``size``)."""
    return manifests.groupBy("blob").agg(F.sum("size").cast("long").alias("gross_bytes"), F.count("*").alias("refs"))


def kind(name: Column) -> Column:
    """What a file of a store is: checkpoint, manifest, segment, temporary (of a crashed writer) or other."""
    return (
        F.when(name.rlike(r"\.ckpt$"), "checkpoint").when(name.rlike(r"\.ckm$"), "manifest").when(name.rlike(r"\.seg$"), "segment").when(name.rlike(r"\.ckpt\.tmp"), "temporary").otherwise("other")
    )


def physical_bytes(files: DataFrame, name: str = "name", length: str = "length") -> DataFrame:
    """Bytes on disk by kind of file."""
    return files.groupBy(kind(F.col(name)).alias("kind")).agg(F.count("*").alias("files"), F.sum(length).cast("long").alias("bytes"))


def stale_temporaries(files: DataFrame, before: Column, name: str = "name", modified: str = "modificationTime") -> DataFrame:
    """Files that a crashed writer left, older than ``before``."""
    return files.where((kind(F.col(name)) == "temporary") & (F.col(modified) < before))


def live_manifests(files: DataFrame, name: str = "name") -> DataFrame:
    """stem, checkpoint, manifest: chunked checkpoints beside their manifests, matched by the name without its suffix."""
    stem = F.regexp_replace(name, r"\.(ckpt|ckm)$", "")
    side = lambda k: files.where(kind(F.col(name)) == k).select(stem.alias("stem"), F.col(name).alias(k))
    return side("checkpoint").join(side("manifest"), "stem")
