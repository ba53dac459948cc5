"""Mixing sources to target weights (operator 9), DataFrame functions only.

Every document gets a hash-random key. The sizes (no texts) are range-partitioned by source, key and a
random tie-break, so that no source and no key, repeated or null ids included, is one task's; sums by
source and range give each range's start, and within a range a running sum orders its documents. Each
source is cut at its exact budget: whole epochs first, the rest from the front of the random order, the
last document in part. Rows that only the tie-break tells apart have one id and size, so whichever
comes first the result is the same set of rows.

Targets: the weights 5, 2, 1, 5, 2, 1, ... over the sources by code point, null last, share all
words; a target stops at ``max_epochs`` times its source's words, and the excess goes to the others
by weight until none is above. With caps c, weights w and total W, sort by c / w: source i is capped
iff c_i / w_i <= (W - sum of c before i) / (sum of w from i), so running sums decide it at once.

Defined results: a null text has size 0 and is taken 0 words; a very long text is counted whole; a null
source is a source; repeated rows and null ids have equal keys and are cut one after the other; with no words at all every target is 0; an
empty table gives an empty result; extra columns pass through, but for those named like RESULTS,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, words, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RESULTS = ("size", "source_size", "target", "taken")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with size: its words."""
    return docs.select(*others(docs, text, *RESULTS), F.size(words(F.col(text))).cast("long").alias("size"))


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row per source: source, source_size, target (double). Its windows see one row per source, never documents."""
    s = sizes.groupBy(F.col(source).alias("_mx_source")).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_mx_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("_w", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    ratio = F.col("_cap") / F.col("_w")
    order = Window.orderBy(ratio, F.col("_mx_source").asc_nulls_last())
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns(
        {
            "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_weights": F.sum("_w").over(after),
        }
    )
    # Integers decide; the division comes last, so reruns agree to the last bit.
    s = s.withColumn("_capped", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_w"))
    free = F.struct(F.min(F.when(~F.col("_capped"), F.struct(ratio, F.col("_left"), F.col("_weights")))).over(everything).alias("f"))["f"]
    s = s.withColumn("_free", free)
    share = F.col("_free._left") * F.col("_w") / F.col("_free._weights")
    return s.select("_mx_source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """32 hex digits, alike at every rerun."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` without ``text``, with size, source_size, target and taken (words that the mix takes)."""
    spark, key, tie = docs.sparkSession, F.col("_mx_key"), F.col("_mx_tie")
    sizes = written(sized(docs, text).withColumns({"_mx_key": random_key(F.col(doc_id)), "_mx_tie": F.monotonically_increasing_id()}))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(ranges, F.col(source), key, F.col(doc_id), F.col("size"), F.xxhash64(tie))
    sizes = written(dealt.withColumn("_mx_range", F.spark_partition_id()))
    by_range = sizes.groupBy(F.col(source).alias("_mx_s"), F.col("_mx_range").alias("_mx_r")).agg(F.sum("size").alias("_sum"))
    goal = targets(by_range.withColumnsRenamed({"_mx_s": source, "_sum": "size"}), source, weights, max_epochs)
    ahead = Window.partitionBy("_mx_s").orderBy("_mx_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    plan = starts.join(goal, starts["_mx_s"].eqNullSafe(goal["_mx_source"])).drop("_mx_source")
    j = sizes.join(plan, sizes[source].eqNullSafe(plan["_mx_s"]) & (sizes["_mx_range"] == plan["_mx_r"]))
    inside = Window.partitionBy(source, "_mx_range").orderBy(key, F.col(doc_id), F.col("size"), F.xxhash64(tie), tie).rowsBetween(Window.unboundedPreceding, -1)
    ahead_words = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    words_due = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(words_due / F.col("source_size"))).otherwise(F.lit(0))
    rest = words_due - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - ahead_words))
    return j.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("_mx_key", "_mx_tie", "_mx_range", "_mx_s", "_mx_r", "_start")
