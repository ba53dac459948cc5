"""Verdicts, reuse accounting and roll-ups over routed requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = ("missing", "unresolved")


def verdict(matched: Column, n_tokens: Column) -> Column:
    """A match of under two tokens is a miss, one as long as the request a hit."""
    return F.when(matched < 2, "miss").when(matched == n_tokens, "hit").otherwise("partial")


def covered(verdict: Column, matched: Column) -> Column:
    """Reused positions: one less than matched, as the last token's state is never stored."""
    return F.when(verdict == "miss", 0).otherwise(F.greatest(matched - 1, F.lit(0))).cast("long")


def classified(matched: DataFrame) -> DataFrame:
    """``matched`` (tokens, matched_tokens) with n_tokens, verdict and prefill_from."""
    n = F.size("tokens").cast("long")
    v = verdict(F.col("matched_tokens"), n)
    return matched.withColumns({"n_tokens": n, "verdict": v, "prefill_from": covered(v, F.col("matched_tokens"))})


def settled(routed: DataFrame, refused: Column) -> DataFrame:
    """``routed`` with matches whose restore was refused turned into misses."""
    hit = F.coalesce(refused, F.lit(False)) & (F.col("verdict") != "miss")
    return routed.withColumn("prefill_from", F.when(hit, 0).otherwise(F.col("prefill_from")).cast("long")).withColumn("verdict", F.when(hit, "miss").otherwise(F.col("verdict")))


def stats(routed: DataFrame, *keys: str) -> DataFrame:
    """Counters and hit rate (4 decimals, 0 without tokens) by ``keys``."""
    share = F.round(F.coalesce(F.sum("prefill_from") / F.nullif(F.sum("n_tokens"), F.lit(0)), F.lit(0.0)), 4)
    counts = [F.count_if(F.col("verdict") == v).alias(a) for v, a in (("hit", "hits"), ("partial", "partials"), ("miss", "misses"))]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("prefill_from", "tokens_cached"), ("n_tokens", "tokens_total"))]
    return routed.groupBy(*keys).agg(F.count("*").alias("requests"), *counts, *sums, share.alias("hit_rate"))


def histogram(routed: DataFrame) -> DataFrame:
    return routed.groupBy(F.coalesce("verdict", F.lit("n/a")).alias("verdict")).agg(F.count("*").alias("n"))


def settle_reason(text: Column) -> Column:
    """The reason code before a colon; ``unspecified`` if it isn't one."""
    code = F.substring_index(text, ":", 1)
    return F.when(code.rlike("^[a-z0-9_]+$"), code).otherwise("unspecified")


def finish_reason(max_tokens: Column, generated: Column) -> Column:
    return F.when((max_tokens > 0) & (generated >= max_tokens), "length").otherwise("stop")


def error_class(status: Column) -> Column:
    return F.when(status == 422, "rejected").when(status == 503, "transport").otherwise("upstream")


def from_scratch(requests: DataFrame) -> DataFrame:
    """``requests`` (tokens) as they are decided without a lookup: all misses."""
    return classified(requests.withColumn("matched_tokens", F.lit(0).cast("long")))
