"""Made-up request workloads over a prefix text, and what a store under pressure keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lifecycle, policy, prefix

MESSAGES = "array<struct<role:string,content:string>>"
ARMS = ("p_alone", "p_extended")


def _message(role: str, content) -> object:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _asked(i) -> object:
    return F.format_string("Question %d: answer in one short paragraph.", i)


def shared_prefix(spark: SparkSession, text: str, questions: int, primed: bool = True) -> DataFrame:
    """One prefix and short changing questions; ``primed``: the prefix alone comes first."""
    name = "shared_prefix" if primed else "shared_prefix_unprimed"
    rows = spark.range(-1 if primed else 0, questions).withColumnRenamed("id", "i")
    system = _message("system", F.lit(text))
    both = F.when(F.col("i") < 0, F.array(system)).otherwise(F.array(system, _message("user", _asked(F.col("i")))))
    label = F.when(F.col("i") < 0, "prime").otherwise(F.concat(F.lit("q"), F.col("i").cast("string")))
    return rows.select(F.lit(name).alias("workload"), F.col("i").alias("seq"), label.alias("label"), both.cast(MESSAGES).alias("messages"), F.lit(32).alias("max_tokens"))


def near_miss(spark: SparkSession, text: str, questions: int) -> DataFrame:
    """Two documents by turns that share their first half, then part."""
    other = text[: max(1, len(text) // 2)] + "From here on another matter is described, in other words. "
    rows = spark.range(questions).withColumnRenamed("id", "i")
    body = F.when(F.col("i") % 2 == 0, F.lit(text)).otherwise(F.lit(other))
    messages = F.array(_message("system", body), _message("user", _asked(F.col("i"))))
    return rows.select(F.lit("near_miss").alias("workload"), F.col("i").alias("seq"), F.concat(F.lit("q"), F.col("i").cast("string")).alias("label"), messages.cast(MESSAGES).alias("messages"), F.lit(32).alias("max_tokens"))


def long_answers(spark: SparkSession, prompts: int) -> DataFrame:
    """Little is shared, and answers are long: reuse can't help here."""
    rows = spark.range(prompts).withColumnRenamed("id", "i")
    messages = F.array(_message("user", F.format_string("Write a numbered list about topic %d in detail.", F.col("i"))))
    return rows.select(F.lit("long_answers").alias("workload"), F.col("i").alias("seq"), F.concat(F.lit("q"), F.col("i").cast("string")).alias("label"), messages.cast(MESSAGES).alias("messages"), F.lit(256).alias("max_tokens"))


def pressure(spark: SparkSession, text: str, noise: list[int]) -> DataFrame:
    """For each arm and number of unrelated requests: the prefix, in one arm a request that extends it, the noise, and the repeat to be measured."""
    arms = spark.createDataFrame([(a, k) for a in ARMS for k in noise], "arm string, k long")
    system = _message("system", F.lit(text))
    step = lambda kind, messages: F.struct(F.lit(kind).alias("kind"), F.array(*messages).cast(MESSAGES).alias("messages"))
    unrelated = F.transform(F.when(F.col("k") > 0, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: step("noise", [_message("user", F.format_string("Unrelated request %d: say hello.", i))]))
    extend = F.when(F.col("arm") == ARMS[1], F.array(step("extend", [system, _message("user", F.lit("Summarize the policy above in one line."))]))).otherwise(F.slice(unrelated, 1, 0))
    steps = F.concat(F.array(step("prime", [system])), extend, unrelated, F.array(step("repeat", [system, _message("user", F.lit("Repeat question: answer in one short paragraph."))])))
    return arms.select("arm", "k", F.posexplode(steps).alias("seq", "s")).select("arm", "k", "seq", "s.*")


def words(messages: str = "messages") -> object:
    """A plain tokenizer: the words of the messages, each message closed by a mark; the last mark ends the request."""
    one = F.transform(messages, lambda m: F.concat(F.array(F.concat(F.lit("<"), m["role"], F.lit(">"))), F.split(F.trim(m["content"]), " +")))
    return F.concat(F.flatten(one), F.array(F.lit("]")))


def under_pressure(requests: DataFrame, cap: int = 3, sweeps: int = 1) -> DataFrame:
    """arm, k, published, evicted, entry, matched_tokens, verdict of the repeat after ``sweeps`` sweeps under an entry cap, without an anchor window.

    Every arm is a store of its own: its name is the first token, so none extends another's entries.
    """
    store = F.concat_ws("/", "arm", F.col("k").cast("string"))
    rows = requests.withColumn("tokens", F.concat(F.array(store), words())).withColumn("engine", store).withColumn("fp", F.lit("f"))
    entries = rows.where("kind <> 'repeat'").select("arm", "k", "engine", "fp", "tokens", F.concat_ws("/", "engine", F.lpad(F.col("seq").cast("string"), 4, "0")).alias("name"), F.lit(0).alias("granularity"), F.col("seq").cast("long").alias("last_used"))
    total = entries.groupBy("engine").agg(F.count("*").alias("published"))
    left = entries
    for _ in range(sweeps):
        left = left.join(lifecycle.capped(prefix.with_anchor(left), cap, "engine").select("name"), "name", "left_anti")
    probe = rows.where("kind = 'repeat'").select(F.col("seq").cast("long").alias("request_id"), "arm", "k", "engine", "fp", "tokens")
    found = policy.classified(prefix.matches(probe.withColumn("request_id", F.xxhash64("engine")), left))
    kept = left.groupBy("engine").agg(F.count("*").alias("_left"))
    j = found.join(total, "engine").join(kept, "engine", "left")
    return j.select("arm", "k", "published", (F.col("published") - F.coalesce("_left", F.lit(0))).alias("evicted"), "entry", "matched_tokens", "verdict")
