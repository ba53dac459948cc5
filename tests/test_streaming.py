"""Stream forms against their batch results."""

from pyspark.sql import functions as F

from prefixloom.streaming import online

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    return spark.table(name)


def test_tumbling_counts_match_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = drained(spark, online.tumbling(stream, "ts", "1 hour", "10 minutes", "event_type"), "tumbled", "complete")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_matched_online(spark, tmp_path):
    rows = [(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [1, 2, 3, 4]), (4, [1, 2, 9]), (5, [8]), (6, [7, 7])]
    df = spark.createDataFrame([(i, "e", "f", [str(x) for x in t]) for i, t in rows], "request_id long, engine string, fp string, tokens array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))
    got = drained(spark, online.matched_online(stream), "matched", "append")
    assert [(r.request_id, r.matched_tokens, r.verdict, r.prefill_from) for r in got.orderBy("request_id").collect()] == [
        (1, 0, "miss", 0), (2, 3, "hit", 2), (3, 3, "partial", 2), (4, 3, "hit", 2), (5, 0, "miss", 0), (6, 0, "miss", 0),
    ]


def streamed(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_sliding_and_session_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = streamed(spark, events, tmp_path / "e")
    got = drained(spark, online.sliding(stream, "ts", "1 hour", "30 minutes", "10 minutes"), "slid", "complete")
    want = events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = drained(spark, online.sessions(stream, "ts", "2 hours", "10 minutes", "user_id"), "sessions", "complete")
    want = events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_single_flight_keeps_one_of_each_key(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = drained(spark, online.single_flight(streamed(spark, df, tmp_path / "s"), "ts", "1 hour", "k"), "single", "append")
    assert sorted(r.k for r in got.collect()) == ["a", "b"]
