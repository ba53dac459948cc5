"""Engine inputs derived from the driver tables, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, tokens: the words of all turns so far. A conversation is one chain of bounded turns."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.flatten(F.collect_list(F.split("text", " ")).over(so_far)).alias("tokens"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of the even turns."""
    return turns(spark, sf_dir).where("turn % 2 = 0").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-t"), "turn").alias("name"), F.concat(F.lit("e"), F.col("conv_id") % 2).alias("engine"), F.concat(F.lit("f"), F.col("conv_id") % 3).alias("fp"),
        "tokens", F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0).alias("granularity"), (F.col("conv_id") * 10 + F.col("turn")).alias("last_used"), (F.size("tokens") * 64).cast("long").alias("size_bytes"), "conv_id", "turn",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns: as they are, with another last token, with one more, with another first token."""
    t = F.col("tokens")
    n = F.size(t)
    kind = F.col("conv_id") % 4
    other = F.when(kind == 0, t).when(kind == 1, F.concat(F.slice(t, F.lit(1), n - 1), F.array(F.lit("?")))).when(kind == 2, F.concat(t, F.array(F.lit("]")))).otherwise(F.concat(F.array(F.lit("?")), F.slice(t, F.lit(2), n - 1)))
    return turns(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.concat(F.lit("e"), F.col("conv_id") % 2).alias("engine"), F.concat(F.lit("f"), F.col("conv_id") % 3).alias("fp"), F.when(F.col("turn") % 3 == 0, t).otherwise(other).alias("tokens"), "conv_id", "turn",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """convo, turn, blob, payload: the hex digits of all turns' text so far."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.collect_list(F.hex("text")).over(so_far), "")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("convo"), "turn", F.concat(F.lit("c"), "conv_id", F.lit("-t"), "turn").alias("blob"), text.alias("payload"))


def records(chunks: DataFrame) -> DataFrame:
    """Segment records of the chunks, some held twice."""
    v = F.conv(F.substring("digest", 1, 6), 16, 10).cast("long")
    one = chunks.select("digest", F.col("size").alias("body_len")).distinct().withColumn("v", v)
    first = one.select((F.col("v") % 5).alias("seg"), F.col("v").alias("rec_off"), "body_len", "digest")
    return first.unionByName(one.where("v % 7 = 0").select((F.col("v") % 5 + 1).alias("seg"), F.col("v").alias("rec_off"), "body_len", "digest"))


TURNS = "turns AS (SELECT conv_id, turn, flatten(list(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn)) AS tokens FROM conversations)"
ENTRIES = f"""{TURNS},
entries AS (SELECT 'c' || conv_id || '-t' || turn AS name, 'e' || conv_id % 2 AS engine, 'f' || conv_id % 3 AS fp, tokens, len(tokens) AS k,
  CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS granularity, conv_id * 10 + turn AS last_used, (len(tokens) * 64)::BIGINT AS size_bytes, conv_id, turn
  FROM turns WHERE turn % 2 = 0)"""
ROUTED = f"""{ENTRIES},
requests AS (SELECT conv_id * 1000 + turn AS request_id, 'e' || conv_id % 2 AS engine, 'f' || conv_id % 3 AS fp, conv_id, turn,
  CASE WHEN turn % 3 = 0 OR conv_id % 4 = 0 THEN tokens WHEN conv_id % 4 = 1 THEN list_concat(tokens[1:len(tokens) - 1], ['?'])
       WHEN conv_id % 4 = 2 THEN list_concat(tokens, [']']) ELSE list_concat(['?'], tokens[2:]) END AS tokens FROM turns),
pairs AS (SELECT r.request_id, e.name, e.k, e.last_used, e.tokens[e.k] AS last, r.tokens[e.k] = e.tokens[e.k] AS on_path, e.granularity, len(r.tokens) AS n
  FROM requests r JOIN entries e ON r.engine = e.engine AND r.fp = e.fp AND e.k >= 2 AND len(r.tokens) >= e.k AND r.tokens[1:e.k - 1] = e.tokens[1:e.k - 1]),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY k DESC, on_path DESC, last_used DESC, last, name) AS rn FROM pairs
  WHERE CASE WHEN granularity = 1 THEN on_path AND k = n ELSE true END) WHERE rn = 1),
routed AS (SELECT r.request_id, r.conv_id, r.turn, len(r.tokens)::BIGINT AS n_tokens, w.name AS entry, coalesce(w.k, 0)::BIGINT AS matched_tokens, w.on_path,
  CASE WHEN coalesce(w.k, 0) < 2 THEN 'miss' WHEN w.k = len(r.tokens) THEN 'hit' ELSE 'partial' END AS verdict,
  (CASE WHEN coalesce(w.k, 0) < 2 THEN 0 ELSE w.k - 1 END)::BIGINT AS prefill_from
  FROM requests r LEFT JOIN won w USING (request_id))"""
CHUNKS = """pay AS (SELECT conv_id AS convo, turn, 'c' || conv_id || '-t' || turn AS blob, string_agg(hex(text), '') OVER (PARTITION BY conv_id ORDER BY turn) AS payload FROM conversations),
chunks AS (SELECT convo, turn, blob, i::BIGINT AS chunk_no, sha256(substring(payload, i * 256 + 1, 256)) AS digest, length(substring(payload, i * 256 + 1, 256))::BIGINT AS size
  FROM pay, unnest(range(0, (length(payload) + 255) // 256)) AS u(i))"""
RECORDS = f"""{CHUNKS},
one AS (SELECT DISTINCT digest, size AS body_len, ('0x' || substr(digest, 1, 6))::BIGINT AS v FROM chunks),
records AS (SELECT v % 5 AS seg, v AS rec_off, body_len, digest FROM one UNION ALL SELECT v % 5 + 1, v, body_len, digest FROM one WHERE v % 7 = 0),
live AS (SELECT DISTINCT digest FROM chunks WHERE turn % 2 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY seg DESC, rec_off) = 1 AS here FROM records),
stats AS (SELECT seg, sum(body_len + 36)::BIGINT AS total, coalesce(sum(CASE WHEN NOT (here AND l.digest IS NOT NULL) THEN body_len + 36 END), 0)::BIGINT AS dead,
  count(*) FILTER (WHERE here AND l.digest IS NOT NULL) AS live_records FROM placed LEFT JOIN live l USING (digest) GROUP BY seg)"""
