"""Trace scoring and latency summaries; percentiles by index, in the three conventions in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evict import prefix_max, prefix_sums


def _at(df: DataFrame, value: str, keys: list[str], index, names: dict[str, float]) -> DataFrame:
    """By ``keys``: the value at ``index(n, p)`` of the sorted group for every name and p; rows with a null key or value are left out.

    Equal values are counted first, and ranks are prefix sums of the counts, so neither a hot group nor a
    frequent value is sorted in one task.
    """
    known = df.dropna(subset=[*keys, value])
    counts = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    r = prefix_sums(counts, "_c", [F.col("_v")], "_i", by=tuple(keys))
    r = r.join(known.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    here = lambda p: (F.col("_i") <= index(F.col("_n"), p)) & (index(F.col("_n"), p) < F.col("_i") + F.col("_c"))
    return r.groupBy(*keys).agg(*[F.max(F.when(here(p), F.col("_v"))).alias(a) for a, p in names.items()], F.max("_n").alias("n"))


def pct_index(df: DataFrame, value: str, keys: list[str], names: dict[str, float]) -> DataFrame:
    """The value at min(n - 1, int(n p))."""
    return _at(df, value, keys, lambda n, p: F.least(n - 1, F.floor(n * p)), names)


def pct_round(df: DataFrame, value: str, keys: list[str], names: dict[str, float]) -> DataFrame:
    """The value at round(p (n - 1)), halves to even."""
    return _at(df, value, keys, lambda n, p: F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(p) * (n - 1)))), names)


def restore_stats(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Least, s[n // 2] and s[min(n - 1, int(0.9 n))], to 4 decimals."""
    p = _at(df, value, keys, lambda n, p: F.least(n - 1, F.floor(n * p)), {"min_s": 0.0, "median_s": 0.5, "p90_s": 0.9})
    return p.select(*keys, *[F.round(c, 4).alias(c) for c in ("min_s", "median_s", "p90_s")], "n")


def suppressed(value: Column, n: Column, least: int = 100) -> Column:
    return F.when(n >= least, value)


def tpot(total_ms: Column, ttft_ms: Column, tokens_out: Column) -> Column:
    return (total_ms - ttft_ms) / F.greatest(tokens_out - 1, F.lit(1))


def leg_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """By leg: samples, instrumented ones, tokens, served and reuse shares (null without instrumented samples)."""
    seen = F.col("verdict").isNotNull()
    share = lambda c: F.round(100 * F.sum(F.when(seen, F.col(c))) / F.nullif(F.sum(F.when(seen, F.col("prompt_tokens"))), F.lit(0)), 2)
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(seen).alias("n_instrumented"), F.sum("prompt_tokens").cast("long").alias("prompt_tokens"), share("served").alias("served_pct"), share("declared_lcp").alias("reuse_pct"))


def premise_violations(samples: DataFrame) -> DataFrame:
    """A row per broken premise of a sample."""
    tests = {"lcp_over_prompt": F.col("declared_lcp") > F.col("prompt_tokens"), "served_over_lcp": F.col("served") > F.col("declared_lcp"), "hit_without_reuse": (F.col("verdict") == "hit") & (F.col("served") == 0)}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return samples.withColumn("problem", F.explode(found))


def positional_join(samples: DataFrame, records: DataFrame, key: str, order_a: str, order_b: str, offset: int = 0) -> DataFrame:
    """The i-th sample with the i-th record after ``offset`` of each ``key`` (not null); matched is false for all of a key whose counts differ.

    Places are prefix sums, so a hot key's rows are numbered by many tasks.
    """
    i = lambda df, o: prefix_sums(df.dropna(subset=[key]).withColumn("_one", F.lit(1).cast("long")), "_one", [F.col(o)], "_i", by=(key,)).drop("_one")
    later = i(records, order_b).withColumn("_i", F.col("_i") - offset).where("_i >= 0")
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    same = n(samples, "_a").join(n(later, "_b"), key).select(key, (F.col("_a") == F.col("_b")).alias("matched"))
    return i(samples, order_a).join(later, [key, "_i"]).join(same, key).drop("_i")


def counter_delta(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Last minus first snapshot of each counter."""
    return snapshots.groupBy(key).agg((F.max_by(value, order) - F.min_by(value, order)).alias("delta"))


def single_flight(requests: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``requests`` with flight: overlapping requests of a key (not null) share one, numbered in order of start.

    A running maximum of ends, then a running sum of openings, both by ranges: a hot key's requests lie across many tasks.
    """
    order = [F.col(start), F.col(end)]
    seen = prefix_max(requests.dropna(subset=[key]), end, order, "_ahead", by=(key,))
    opens = F.when(F.col("_ahead").isNull() | (F.col(start) > F.col("_ahead")), 1).otherwise(0).cast("long")
    out = prefix_sums(seen.withColumn("_o", opens), "_o", order, "_f", by=(key,))
    return out.withColumn("flight", F.col("_f") + F.col("_o")).drop("_o", "_f", "_ahead")


def monotonic_breaks(rows: DataFrame, size: str, value: str, keys: list[str]) -> DataFrame:
    """Rows whose value is below that of the next smaller size."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(size))
    return rows.withColumn("previous", before).where(F.col(value) < F.col("previous"))


def medians(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """By ``keys``: the median, between the two middle values where they are two, and the mean."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.round(F.avg(value), 1).alias("mean"), F.count(value).alias("n"))


def steady_mean(value: Column) -> Column:
    """The mean of doubles, the same in any order of rows: summed and divided as decimals; in floating point only where a value or the sum is none (NaN, 1e26)."""
    d = value.try_cast("decimal(38,12)")
    return F.coalesce(F.when(F.count(d) == F.count(value), F.try_avg(d).cast("double")), F.avg(value))


def leg_latencies(samples: DataFrame, *keys: str) -> DataFrame:
    """By leg: latencies of samples (ttft_ms, tpot_ms) by rank, the mean, the 95th percentile only of 100 samples and more."""
    t = pct_round(samples, "ttft_ms", list(keys), {"ttft_p50_ms": 0.5, "ttft_p95_ms": 0.95})
    p = pct_round(samples, "tpot_ms", list(keys), {"tpot_p50_ms": 0.5}).drop("n")
    mean = samples.groupBy(*keys).agg(F.round(steady_mean(F.col("ttft_ms")), 1).alias("ttft_mean_ms"))
    j = t.withColumn("ttft_p95_ms", suppressed(F.col("ttft_p95_ms"), F.col("n"))).join(p, list(keys), "left").join(mean, list(keys))
    return j


def score_agreement(samples: DataFrame, records: DataFrame, *keys: str) -> DataFrame:
    """By leg: totals of samples (prompt_tokens, served) beside those of trace records (n_tokens, prefill_from), and whether counts and totals agree."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    a = samples.groupBy(*keys).agg(F.count("*").alias("samples"), total("prompt_tokens").alias("samples_tokens"), total("served").alias("samples_served"))
    b = records.groupBy(*keys).agg(F.count("*").alias("records"), total("n_tokens").alias("tokens_total"), total("prefill_from").alias("tokens_reused"))
    j = a.join(b, list(keys), "full")
    same = F.col("samples").eqNullSafe(F.col("records")) & F.col("samples_tokens").eqNullSafe(F.col("tokens_total")) & F.col("samples_served").eqNullSafe(F.col("tokens_reused"))
    return j.withColumn("agrees", same)


def phases(timings: DataFrame, phase: str = "phase", seconds: str = "seconds") -> DataFrame:
    """By phase: runs, their total and mean seconds."""
    return timings.groupBy(phase).agg(F.count(seconds).alias("runs"), F.round(F.sum(seconds), 6).alias("total_s"), F.round(F.avg(seconds), 6).alias("mean_s"))


def per_token(payload_bytes: Column, tokens: Column) -> Column:
    return F.round(payload_bytes / F.greatest(tokens, F.lit(1)), 1)


def first_token(events: DataFrame, key: str, ts: str, kind: str) -> DataFrame:
    """By request: milliseconds from its start to its first token; null without one. Also over a stream, in update mode."""
    at = lambda k: F.min(F.when(F.col(kind) == k, F.unix_millis(ts)))
    return events.groupBy(key).agg((at("token") - at("start")).alias("ttft_ms"))
