"""Trace files of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "ts_ms bigint, model string, model_hash string, n_tokens bigint, verdict string, matched_tokens bigint, prefill_from bigint, messages string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of lines that are no JSON record. A file is numbered as it is read, whole, in one task."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    text = F.trim(F.regexp_replace("text", "\r$", ""))
    sound = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    return files.where((text != "") & ~sound).select("file", (F.col("at") + 1).alias("line"), "text")


def problems(trace: DataFrame) -> DataFrame:
    """One row: records and those without messages; a trace is refused if it is empty or any lack them."""
    lacking = F.count_if(F.col("messages").isNull())
    return trace.agg(F.count("*").alias("records"), lacking.alias("without_messages"), ((F.count("*") == 0) | (lacking > 0)).alias("refused"))


def write(routed: DataFrame, path: str) -> None:
    """One compact line per request."""
    routed.write.mode("errorifexists").json(path)
