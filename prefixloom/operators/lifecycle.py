"""Checkpoint lifecycle as whole-table transforms: nothing is changed in place, each returns a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import identity, prefix
from .evict import candidates, prefix_sums


def keep_latest(entries: DataFrame, *keys: str) -> DataFrame:
    """``entries`` with stale: a newer generation (then a greater name) has the same keys. Compared by hash of nothing but the keys themselves."""
    newest = entries.groupBy(*keys).agg(F.max(F.struct("generation", "name")).alias("_n"))
    return entries.join(newest, list(keys)).withColumn("stale", (F.col("_n.generation") != F.col("generation")) | (F.col("_n.name") != F.col("name"))).drop("_n")


def ranked(entries: DataFrame, key: str) -> DataFrame:
    """The best of each key by format version, then name."""
    best = F.max(F.struct("format_version", "name")).alias("b")
    return entries.groupBy(key).agg(best).select(key, "b.name", "b.format_version")


def superseded_names(entries: DataFrame, key: str) -> DataFrame:
    """Names that have a greater name at the same key."""
    later = F.lead("name").over(Window.partitionBy(key).orderBy("name"))
    return entries.withColumn("superseded_by", later).where("superseded_by IS NOT NULL")


def publish(entries: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Both tables, each key's latest only."""
    return keep_latest(entries.unionByName(new), *keys).where("NOT stale").drop("stale")


def orphans(manifests: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return manifests.join(live, key, "left_anti")


def rebuild_report(blobs: DataFrame) -> DataFrame:
    """Counts over scanned blobs (name, tokens, token_count, size_bytes, digest, payload_digest, generation, engine, fp)."""
    bad = F.when(F.size("tokens") != F.col("token_count"), "token_count").when(F.size("tokens") < 2, "too_short").when(F.col("size_bytes") <= 0, "empty")
    checked = blobs.withColumn("reject", bad.when(F.lower("digest") != F.col("payload_digest"), "digest"))
    latest = keep_latest(checked.where("reject IS NULL"), "engine", "fp", "tokens")
    state = latest.select(F.when(F.col("stale"), "stale").otherwise("published").alias("state")).unionByName(checked.where("reject IS NOT NULL").select(F.col("reject").alias("state")))
    return state.groupBy("state").agg(F.count("*").alias("n"))


def quarantine_excess(entries: DataFrame, keep: int) -> DataFrame:
    """Quarantined entries over the cap, the coldest first."""
    q = entries.where("state = 'quarantined'")
    n = q.agg(F.count("*")).scalar()
    ranked = prefix_sums(q.withColumn("_one", F.lit(1)), "_one", [F.col("last_used"), F.col("name")], "rank").drop("_one")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).where(F.col("rank") <= n - keep)


def invalidate(entries: DataFrame, key: list) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes when ``key`` and all below it are dropped."""
    gone = prefix.subtree(entries, key)
    return entries.join(gone.select("name"), "name", "left_anti"), gone


def generation_of(path: Column) -> Column:
    """Generation in a file name `{hash:032x}-{generation:016x}.ckpt`, null if it isn't one."""
    pattern = r"([0-9a-f]{32})-([0-9a-f]{16})\.ckpt$"
    return F.when(path.rlike(pattern), F.conv(F.regexp_extract(path, pattern, 2), 16, 10).cast("decimal(20,0)"))


def opened(blobs: DataFrame, trust_legacy: bool = False) -> DataFrame:
    """``blobs`` (name, key, reject, format_version, payload_sha256) with state, as a store finds them when it opens.

    ``corrupt`` (a reject, or a name that isn't its header's) and ``superseded`` (not the best of its key by format version,
    then name) are reclaimed, ``legacy`` (no digest) stays unindexed unless trusted, the rest is ``indexed``.
    """
    corrupt = F.col("reject").isNotNull() | (F.col("payload_sha256").isNotNull() & ~identity.bound(F.col("name"), F.col("key")))
    first = blobs.withColumn("state", F.when(corrupt, "corrupt").when(F.col("payload_sha256").isNull() & ~F.lit(trust_legacy), "legacy").otherwise("indexed"))
    best = ranked(first.where("state = 'indexed'"), "key").select(F.col("name").alias("_best"))
    out = first.join(best, F.col("name") == F.col("_best"), "left")
    return out.withColumn("state", F.when((F.col("state") == "indexed") & F.col("_best").isNull(), "superseded").otherwise(F.col("state"))).drop("_best")


def put(entries: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without superseded names (a name goes if a greater one has its key), and those names: name, superseded_by."""
    both = entries.unionByName(new)
    last = both.groupBy(key).agg(F.max("name").alias("_last"))
    marked = both.join(last, key)
    gone = superseded_names(both, key).select("name", "superseded_by")
    return marked.where("name = _last").select(*entries.columns), gone


def quarantined(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """``entries`` with state quarantined where a target has the name, generation and tokens of a published one."""
    hit = targets.select("name", "generation", "tokens").distinct().withColumn("_hit", F.lit(True))
    j = entries.join(hit, ["name", "generation", "tokens"], "left")
    return j.withColumn("state", F.when(F.col("_hit") & (F.col("state") == "published"), "quarantined").otherwise(F.col("state"))).select(*entries.columns)


def removed(entries: DataFrame, targets: DataFrame, state: str) -> DataFrame:
    """``entries`` without those of ``state`` that a target names by name, generation and tokens: a newer generation at the same name stays."""
    hit = targets.select("name", "generation", "tokens").distinct().withColumn("state", F.lit(state))
    return entries.join(hit, ["name", "generation", "tokens", "state"], "left_anti").select(*entries.columns)


def state_counts(entries: DataFrame) -> DataFrame:
    """One row: published and quarantined entries."""
    return entries.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("published", "quarantined")])


def last_generation(names: DataFrame, name: str = "name") -> DataFrame:
    """One row: the greatest generation of all names that have one, 0 without."""
    return names.agg(F.coalesce(F.max(generation_of(F.col(name))), F.lit(0)).cast("decimal(20,0)").alias("generation"))


def reserved(new: DataFrame, names: DataFrame, order: str, name: str = "name") -> DataFrame:
    """``new`` with generation: consecutive numbers from after the last one in use, in ``order``."""
    one = new.withColumn("_one", F.lit(1).cast("long"))
    out = prefix_sums(one, "_one", [F.col(order)], "_ahead").drop("_one")
    return out.withColumn("generation", (last_generation(names, name).scalar() + F.col("_ahead") + 1).cast("decimal(20,0)")).drop("_ahead")


def evict_cold(entries: DataFrame, cap: int | None, budget: int | None, now: int, window: int) -> DataFrame:
    """Victims of one sweep of a daemon: name, reason (``cap``, ``budget`` or ``tombstone``).

    Published entries go most tokens first, as long as there are more than ``cap`` or they hold more than ``budget`` bytes;
    anchors and recently used ones stay. Quarantined entries beyond ``cap`` (all of them without one) go, the coldest first.
    """
    live = entries.where("state = 'published'")
    marked = prefix.with_anchor(live)
    total = live.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))).scalar()
    c = candidates(marked, now, window).withColumn("_one", F.lit(1).cast("long"))
    order = [F.size("tokens").desc(), F.col("name")]
    c = prefix_sums(c, "_one", order, "_rank")
    c = prefix_sums(c.select("name", "tokens", "size_bytes", "_rank"), "size_bytes", order, "_freed")
    over_cap = F.lit(False) if cap is None else F.col("_rank") < total["n"] - cap
    over_budget = F.lit(False) if not budget else total["b"] - F.col("_freed") > budget
    victims = c.where(over_cap | over_budget).select("name", F.when(over_cap, "cap").otherwise("budget").alias("reason"))
    stones = quarantine_excess(entries, cap or 0).select("name", F.lit("tombstone").alias("reason"))
    return victims.unionByName(stones)


def capped(marked: DataFrame, cap: int, store: str) -> DataFrame:
    """Victims of one sweep in each of many small stores: most tokens first, no anchors (is_anchor), until ``cap`` entries are left."""
    w = Window.partitionBy(store)
    rank = F.row_number().over(w.orderBy("is_anchor", F.size("tokens").desc(), "name"))
    return marked.withColumns({"_rank": rank, "_n": F.count("*").over(w)}).where((F.col("_rank") <= F.col("_n") - cap) & ~F.col("is_anchor")).drop("_rank", "_n")
