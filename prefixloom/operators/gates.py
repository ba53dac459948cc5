"""Acceptance predicates over measured rows: sweeps, agreement of outputs, reuse gates, settlement checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The gates' thresholds, the token and byte caps of settlement.
LEAST_SKIP_PCT, SWAP_FLOOR_MB, REPEAT_TOLERANCE = 90, 256.0, 0.25
TOKEN_CAP, BYTE_CAP = 32_768, 2 << 30
SHAPE_FIELDS = ("tokenizer_hash", "kv_dtype", "kv_layout_version", "kv_bits", "kv_group_size", "cache_layout", "kv_tier")


def first_of(reasons: dict[str, Column]) -> Column:
    """The first reason that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in reasons.items()])


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with agreement (equal places over the longer length, 0 for two empty arrays) and first_divergence (from 0, null if none)."""
    n = F.greatest(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x.eqNullSafe(y))
    share = F.size(F.filter(same, lambda s: s)) / F.greatest(n, F.lit(1))
    at = F.array_position(same, F.lit(False))
    return pairs.withColumns({"agreement": share, "first_divergence": F.when(at > 0, at - 1)})


def divergence_char(a: Column, b: Column) -> Column:
    """The first place (from 0) where two texts differ within the shorter; null if none."""
    n = F.least(F.length(a), F.length(b))
    pair = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x != y)
    at = F.array_position(pair, F.lit(True))
    return F.when(at > 0, at - 1)


def reuse_gate(legs: DataFrame, *keys: str) -> DataFrame:
    """By ``keys`` over legs (identical, measured, disk_hits, reuse_errors, tokens_reused, tokens_total): skip_pct, ok and reasons.

    All outputs must be identical, the skipped share of prefill at least LEAST_SKIP_PCT, every measured leg
    must have hits, and none may have errors.
    """
    measured = F.coalesce("measured", F.lit(False))
    skip = F.round(100 * F.sum("tokens_reused") / F.nullif(F.sum("tokens_total"), F.lit(0)), 1)
    g = legs.groupBy(*keys).agg(
        skip.alias("skip_pct"), F.bool_and(F.coalesce("identical", F.lit(False))).alias("_same"),
        F.bool_and(~measured | (F.coalesce("disk_hits", F.lit(0)) > 0)).alias("_hits"), F.bool_or(measured & (F.coalesce("reuse_errors", F.lit(0)) > 0)).alias("_errors"),
    )
    found = F.array_compact(F.array(F.when(~F.col("_same"), "divergence"), F.when(F.coalesce("skip_pct", F.lit(0.0)) < LEAST_SKIP_PCT, "skip"), F.when(~F.col("_hits"), "no_disk_hit"), F.when(F.col("_errors"), "reuse_errors")))
    return g.select(*keys, "skip_pct", (F.size(found) == 0).alias("ok"), found.alias("reasons"))


def sweep_refusals(rows: DataFrame, run: str) -> DataFrame:
    """(``run``, size, reason) of context-sweep rows (size, tokens, prefill_s, decode_s, swap_before_mb, swap_after_mb, peak_rss_mb, control)."""
    limit = F.greatest(F.lit(SWAP_FLOOR_MB), F.coalesce("peak_rss_mb", F.lit(0.0)) / 2)
    own = first_of({
        "token_count": ~F.col("tokens").eqNullSafe(F.col("size")), "no_swap_state": F.col("swap_before_mb").isNull() | F.col("swap_after_mb").isNull(),
        "unmeasurable": F.col("prefill_s").isNull() | (F.col("prefill_s") <= 0), "swap_growth": F.col("swap_after_mb") - F.col("swap_before_mb") > limit,
    })
    sweep = rows.where("NOT control")
    larger = F.lead("prefill_s").over(Window.partitionBy(run).orderBy("size"))
    slower = sweep.withColumn("_l", larger).where("prefill_s > _l").select(run, "size", F.lit("slower_than_larger").alias("reason"))
    r = ratios(sweep, run)
    decode = r.where("decode_ratio > prefill_ratio").select(run, F.lit(None).cast("long").alias("size"), F.lit("decode_grew_more").alias("reason"))
    c = rows.where("control").groupBy(run, "size").agg(F.count("*").alias("n"), F.min("prefill_s").alias("lo"), F.max("prefill_s").alias("hi"), F.min_by("prefill_s", "attempt").alias("first"))
    control = c.where((F.col("n") == 2) & ((F.col("hi") - F.col("lo")) / F.nullif(F.col("first"), F.lit(0.0)) > REPEAT_TOLERANCE)).select(run, "size", F.lit("not_repeatable").alias("reason"))
    single = rows.select(run, "size", own.alias("reason")).where("reason IS NOT NULL")
    return single.unionByName(slower).unionByName(decode).unionByName(control)


def ratios(sweep: DataFrame, run: str) -> DataFrame:
    """By run: prefill and decode of the largest size over those of the smallest; no decode ratio unless both are above zero."""
    ends = {f"{c}_{e}": f(f"{c}_s", "size") for c in ("prefill", "decode") for e, f in (("large", F.max_by), ("small", F.min_by))}
    g = sweep.groupBy(run).agg(*[c.alias(k) for k, c in ends.items()])
    decode = F.when((F.col("decode_large") > 0) & (F.col("decode_small") > 0), F.col("decode_large") / F.col("decode_small"))
    return g.select(run, (F.col("prefill_large") / F.nullif(F.col("prefill_small"), F.lit(0.0))).alias("prefill_ratio"), decode.alias("decode_ratio"))


def settle_refusal(most_tokens: int | None = TOKEN_CAP, most_bytes: int | None = BYTE_CAP) -> Column:
    """Why a finished request is not settled, in the order of the checks (tokens, tokenizer_hash, payload_bytes); null if it is. None: no cap."""
    n, held = F.coalesce(F.size("tokens"), F.lit(0)), F.coalesce("payload_bytes", F.lit(0))
    over = lambda c, cap: F.lit(False) if cap is None else c > cap
    return first_of({
        "too_short": n < 2, "identity_unavailable": F.coalesce("tokenizer_hash", F.lit("missing")) == "missing",
        "token_cap": over(n, most_tokens), "empty_payload": held <= 0, "size_cap": over(held, most_bytes),
    })


def settled_matches(prompt: Column, generated: Column, header_tokens: Column, header_fp: Column, fp: Column) -> Column:
    """The settled checkpoint holds prompt and generated tokens, and agrees in the fields that shape its payload."""
    same = F.concat(prompt, generated) == header_tokens
    for f in SHAPE_FIELDS:
        same &= header_fp[f].eqNullSafe(fp[f])
    return F.coalesce(same, F.lit(False))


def usable(entry_tokens: Column, request: Column, matched: Column) -> Column:
    """A restored checkpoint may be used: it has ``matched`` tokens, and all but its last begin the request."""
    n = F.size(entry_tokens)
    return (n == matched) & (n >= 2) & (F.slice(entry_tokens, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(request, F.lit(1), F.greatest(n - 1, F.lit(0))))


def usability(entry_tokens: Column, request: Column, payload_bytes: Column, sound: Column) -> Column:
    """What a restored checkpoint is: ``rejected`` (to be retired), ``unusable`` (the request runs from scratch, the entry stays) or ``usable``.

    Rejected: no tokens recorded, a payload that is empty or not ``sound``, or tokens but the last that aren't the request's.
    Unusable: fewer than two tokens, or more than the request has.
    """
    n = F.coalesce(F.size(entry_tokens), F.lit(0))
    head = F.greatest(n - 1, F.lit(0))
    apart = F.slice(entry_tokens, F.lit(1), head) != F.slice(request, F.lit(1), head)
    return (
        F.when(n < 1, "rejected").when((n < 2) | (n > F.size(request)), "unusable").when(apart | (F.coalesce(payload_bytes, F.lit(0)) <= 0) | ~F.coalesce(sound, F.lit(False)), "rejected").otherwise("usable")
    )
