"""Published versions, captures, event lines, reports, workloads, vector frames, streams and SQL functions."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.functions import keys, register
from prefixloom.operators import identity, lifecycle, policy, prefix, trace, vectors, workloads
from prefixloom.operators.segments import EvictConfig
from prefixloom.sources import published, traces, wire
from prefixloom.streaming import online


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert published.version(spark, root) is None
    first = published.publish(spark.range(3), root)
    assert published.current(spark, root).count() == 3 and published.version(spark, root) == first
    second = published.publish(spark.range(5), root)
    assert published.current(spark, root).count() == 5 and published.snapshot(spark, root, first).count() == 3
    third = published.publish(spark.range(7), root)
    assert published.versions(spark, root) == sorted([first, second, third])
    assert published.prune(spark, root, {first}) == [second] and published.versions(spark, root) == sorted([first, third])


def test_captures(spark):
    rows = [("a", 0, ["x", "y"]), ("a", 1, ["x", "y", "z"]), ("a", 2, ["x", "z"]), ("a", 3, ["x", "z", "u", "v"]), ("b", 0, []), ("b", 1, ["q"])]
    out = published.captured(spark.createDataFrame(rows, "chain string, turn int, names array<string>")).orderBy("chain", "turn").collect()
    assert [(r.new, r.problem) for r in out] == [(["x", "y"], None), (["z"], None), ([], "0 new names"), (["u", "v"], "2 new names"), ([], None), (["q"], None)]


def test_event_lines(spark):
    lines = ['data: {"n": 1}\r', "", ": hi", 'data:{"n": 2}', '{"n": 3}', "data: {broken", "data: [DONE]", 'data: {"n": 9}']
    rows = [("s", i, x) for i, x in enumerate(lines)] + [("open", 0, '{"n": 5}'), (None, 0, "data: [DONE]")]
    df = spark.createDataFrame(rows, "stream string, place int, value string")
    out = published.events(df, "n bigint", "stream", "place").orderBy("stream", "place").collect()
    assert [(r.stream, r.event and r.event.n, r.bad) for r in out] == [("open", 5, None), ("s", 1, None), ("s", 2, None), ("s", 3, None), ("s", None, "{broken")]
    kinds = [r.kind for r in published.event_frames(df.where("stream = 's'")).orderBy("place").collect()]
    assert kinds == ["event", "blank", "comment", "event", "event", "event", "done", "event"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1.5)], "k string, v double")
    out = published.report(df, ["k"])
    assert json.loads(out["json"]) == [{"k": "a", "v": 1.5}, {"k": "b", "v": None}]
    assert out["markdown"] == "| k | v |\n|---|---|\n| a | 1.5 |\n| b | n/a |\n"
    with pytest.raises(ValueError, match="more than 1"):
        published.report(df, ["k"], most=1)
    published.write_report(df, str(tmp_path / "r"), ["k"])
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect()))[0]["k"] == "a"


def test_traces(spark, tmp_path):
    good = '{"ts_ms": 1, "model": "m", "model_hash": "0", "n_tokens": 3, "verdict": "miss", "matched_tokens": 0, "prefill_from": 0, "messages": "[]"}'
    (tmp_path / "t.jsonl").write_text(good + "\n\n" + good.replace("1", "2", 1) + "\n")
    t = traces.read(spark, str(tmp_path / "t.jsonl"))
    assert sorted(r.ts_ms for r in t.collect()) == [1, 2] and not traces.problems(t).first().refused
    traces.write(t, str(tmp_path / "out"))
    assert traces.read(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text(good + "\n\n{oops\n[1]\n" + good)
    assert [(r.line, r.text) for r in traces.bad_lines(spark, str(tmp_path / "bad.jsonl")).orderBy("line").collect()] == [(3, "{oops"), (4, "[1]")]
    assert traces.problems(t.where("false")).first().refused
    assert traces.problems(t.withColumn("messages", F.lit(None).cast("string"))).first().without_messages == 2


def test_workloads(spark):
    text = "one two three four"
    rows = workloads.shared_prefix(spark, text, 2).orderBy("seq").collect()
    assert [(r.label, len(r.messages)) for r in rows] == [("prime", 1), ("q0", 2), ("q1", 2)] and rows[1].messages[0].content == text
    a, b = workloads.near_miss(spark, text, 2).orderBy("seq").collect()
    assert a.messages[0].content == text and b.messages[0].content.startswith(text[:9]) and b.messages[0].content != text
    assert workloads.long_answers(spark, 3).first().max_tokens == 256


def test_pressure(spark):
    text = "a policy " * 40
    out = {(r.arm, r.k): r for r in workloads.under_pressure(workloads.pressure(spark, text, [0, 2, 4])).collect()}
    assert [(out["p_alone", k].evicted, out["p_alone", k].verdict) for k in (0, 2, 4)] == [(0, "partial"), (0, "partial"), (2, "miss")]
    # The prefix ends in a mark that the extension lacks, so it is no anchor: the extension goes first, then the prefix.
    assert [(out["p_extended", k].evicted, out["p_extended", k].verdict) for k in (0, 2, 4)] == [(0, "partial"), (1, "partial"), (3, "miss")]
    more = {(r.arm, r.k): r for r in workloads.under_pressure(workloads.pressure(spark, text, [4]), sweeps=2).collect()}
    assert more["p_extended", 4].published - more["p_extended", 4].evicted == 3


def states(rng, blob, layers=3, positions=5, d=32):
    return [(blob, layer, p, rng.standard_normal(d).astype(float).tolist(), (rng.standard_normal(d) * 3).astype(float).tolist()) for layer in range(layers) for p in range(positions)]


SCHEMA = "blob string, layer int, position int, key array<float>, value array<float>"


def test_frames(spark):
    rng = np.random.default_rng(4)
    good = states(rng, "good")
    rows = good + states(rng, "layers")[:-5] + [(b, layer + 5, *x) for b, layer, *x in states(rng, "gap")] + states(rng, "short")[:-1] + [*states(rng, "dims", 1), ("dims", 0, 5, [1.0] * 8, [1.0] * 32)] + states(rng, "groups", d=30)
    out = {r.blob: r for r in vectors.framed(spark.createDataFrame(rows, SCHEMA), 4, 4, 16).collect()}
    assert {b: r.refused for b, r in out.items()} == {"good": None, "layers": None, "gap": "layers", "short": "positions", "dims": "dims", "groups": "groups"}
    frames = spark.createDataFrame([(r.blob, r.payload) for r in out.values() if r.blob == "good"], "blob string, payload binary")
    assert wire.tensor_fault(bytes(out["good"].payload)) is None
    back = {(r.layer, r.position): r for r in vectors.unframed(frames).collect()}
    assert len(back) == 15
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for _, layer, p, k, v in good:
        assert cos(k, back[layer, p].key) > 0.98 and cos(v, back[layer, p].value) > 0.98
    spoilt = spark.createDataFrame([("good", bytes(out["good"].payload)[:-1])], "blob string, payload binary")
    with pytest.raises(Exception, match="no tensor payload"):
        vectors.unframed(spoilt).collect()


def test_codes_grow_and_come_back(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(64).astype(float).tolist()) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "position int, v array<float>")
    whole = vectors.encoded(df, "v", 64, 3)
    grown = vectors.appended(vectors.encoded(df.where("position < 17"), "v", 64, 3), df.where("position >= 17"), "v", 64, 3)
    key = lambda d: {r.position: (r.packed, r.norm if r.packed else None) for r in d.collect()}
    assert key(whole) == key(grown) and vectors.trimmed(grown, "position", 10).count() == 10
    back = {r.position: r.vector for r in vectors.decoded(whole, 64, 3).collect()}
    assert back[40] is None and np.mean([np.dot(v, back[i]) / np.linalg.norm(v) / np.linalg.norm(back[i]) for i, v in rows[:40]]) > 0.97


def test_fidelity(spark):
    rng = np.random.default_rng(6)
    rows = [(layer, *x[3:]) for layer in range(2) for x in states(rng, "b", 1, 30, 64)] + [(0, [0.0] * 64, [0.0] * 64)]
    out = {r.tier: r for r in vectors.fidelity(spark.createDataFrame(rows, "layer int, key array<float>, value array<float>"), 64, [(3, 2, 64), (4, 4, 64), (4, 8, 32)]).collect()}
    a, b, c = out["tq-k3v2-g64"], out["tq-k4v4-g64"], out["tq-k4v8-g32"]
    assert 0.8 < a.min_layer_cos < b.min_layer_cos <= b.mean_layer_cos <= 1 and c.mean_layer_cos > b.mean_layer_cos
    assert (b.bytes_per_token, a.x_vs_f16 > b.x_vs_f16) == (2 * (32 + 4 + 32 + 4), True)
    with pytest.raises(ValueError, match="groups"):
        vectors.fidelity(spark.createDataFrame(rows[:1], "layer int, key array<float>, value array<float>"), 64, [(3, 2, 48)])


def test_exact_and_coded_search(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.exact_top_k(df, q, 5, block=70, query_block=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(np.float32).astype(float)
    assert got == {i: set(np.argsort(-(y @ y[i]))[:5].tolist()) for i in (0, 100, 200)}


def test_sql_functions(spark):
    assert set(register.register(spark, "t_")) == {"t_" + n for n in (*register.FUNCTIONS, *register.TABLE_FUNCTIONS)}
    fp = identity.fingerprint(model_id=F.lit("golden-model"), tokenizer_hash=F.lit("golden-tok"), kv_dtype=F.lit("f16"), kv_layout_version=F.lit(1))
    rows = spark.range(1).select(fp.alias("fp"), F.expr("CAST(sequence(1, 8) AS array<bigint>)").alias("tokens"))
    rows.createOrReplaceTempView("t_rows")
    got = spark.sql("SELECT t_blob_key(fp, CAST(NULL AS string), tokens) AS a, t_blob_key(fp, 'llama-cpp', tokens) AS b FROM t_rows").first()
    assert tuple(got) == ("2786690f2948dec17c5498a6267fc101", "0f8b99131596e10dfed791048839d6e5")
    data = np.random.default_rng(1).integers(0, 256, 9000, np.uint8).tobytes()
    spark.createDataFrame([(data,)], "p binary").createOrReplaceTempView("t_bytes")
    out = spark.sql("SELECT c.* FROM t_bytes, LATERAL t_content_chunks(p, 1024) c ORDER BY chunk_no").collect()
    assert out[-1].end_off == 9000 and sum(r.size for r in out) == 9000
    v = spark.createDataFrame([(np.arange(64).astype(float).tolist(),)], "v array<float>")
    coded = vectors.encoded(v.select("v", F.col("v").alias("q")), "v", 64, 4)
    coded.createOrReplaceTempView("t_codes")
    assert spark.sql("SELECT t_score_packed(packed, norm, q, 4) FROM t_codes").first()[0] == pytest.approx(float(np.sum(np.arange(64.0) ** 2)), rel=0.02)


def test_identity(spark):
    row = spark.range(1).select(
        identity.engine_domain(F.lit(None).cast("string")).alias("a"), identity.engine_meta(F.lit("mlx-lm")).alias("b"), identity.engine_domain(F.lit("x")).alias("c"),
        identity.model_name(F.lit("m"), F.lit(None).cast("string"), F.lit("d")).alias("d"), identity.model_name(F.lit("m"), F.lit(""), F.lit(None).cast("string")).alias("e"),
        identity.blob_name(F.lit("ab" * 16), F.lit(255)).alias("f"), identity.generation(F.lit(1), F.lit(65537)).alias("g"),
        identity.layout_compatible(F.lit(None).cast("string"), F.lit("")).alias("h"),
    ).first()
    assert tuple(row) == ("mlx-lm", None, "x", "m||d", "unresolved", "ab" * 16 + "-00000000000000ff.ckpt", 65537, True)
    with pytest.raises(ValueError):
        identity.fingerprint(model="x")


def drained(spark, writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    return q


def streamed(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_online_matches_follow_the_batch_rules(spark, tmp_path):
    """Each request against what came before it, by the batch operator."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        t = [str(x) for x in rng.integers(0, 3, int(rng.integers(1, 7)))]
        rows.append((i, "e", "f", t, int(rng.integers(0, 5) == 0)))
    rows.append((60, "e", "missing", ["0", "1"], 0))
    df = spark.createDataFrame(rows, "request_id long, engine string, fp string, tokens array<string>, granularity int")
    drained(spark, online.matched_online(streamed(spark, df, tmp_path / "r")).writeStream.format("memory").queryName("online").outputMode("append"))
    got = {r.request_id: r for r in spark.table("online").collect()}
    known = {}
    for i, _, fp, t, whole in rows:
        if fp == "missing":
            assert got[i].verdict == "miss"
            continue
        best = None
        for e, (used, w) in known.items():
            k = len(e)
            if k < 2 or len(t) < k or tuple(t[: k - 1]) != e[:-1]:
                continue
            on = t[k - 1] == e[-1]
            if not w or on and k == len(t):
                best = min(best or (-k, not on, -used, e[-1], e), (-k, not on, -used, e[-1], e))
        assert (got[i].matched_tokens, got[i].on_path) == ((0, None) if best is None else (-best[0], not best[1])), i
        if best:
            known[best[4]][0] = i
        if len(t) >= 2:
            known[tuple(t)] = [i, whole]


def test_online_state_is_bounded_and_counted(spark, tmp_path):
    rows = [(i, "e", "f", [str(i), "x", *(["y"] if i % 2 else [])]) for i in range(12)]
    df = spark.createDataFrame(rows, "request_id long, engine string, fp string, tokens array<string>")
    drained(spark, online.matched_online(streamed(spark, df, tmp_path / "a"), most_entries=5).writeStream.format("memory").queryName("capped").outputMode("append"))
    assert max(r.evicted for r in spark.table("capped").collect()) == 7
    drained(spark, online.matched_online(streamed(spark, df, tmp_path / "b"), ttl_ticks=3).writeStream.format("memory").queryName("aged").outputMode("append"))
    assert max(r.expired for r in spark.table("aged").collect()) == 8


def test_reaper_and_trace_sink(spark, tmp_path):
    entries = spark.createDataFrame([(f"n{i}", [str(i)] * (i + 2), 10, 0, "published") for i in range(6)] + [("q", ["z", "z"], 1, 0, "quarantined")], "name string, tokens array<string>, size_bytes long, last_used long, state string")
    ticks = streamed(spark, spark.createDataFrame([(1000,)], "now long"), tmp_path / "t")
    seen = []
    take = lambda victims, number: seen.append((number, sorted(tuple(r) for r in victims.collect())))
    drained(spark, online.reaper(ticks, lambda: entries, take, EvictConfig.parsed(max_entries=4, anchor_window_s=1), lambda batch: batch.agg(F.max("now")).first()[0]))
    assert seen == [(0, [("n4", "cap"), ("n5", "cap")])]
    drained(spark, online.reaper(streamed(spark, spark.createDataFrame([(1,)], "now long"), tmp_path / "u"), lambda: entries, take, EvictConfig.parsed(), lambda batch: 0))
    assert len(seen) == 1
    rows = streamed(spark, spark.createDataFrame([(1, "hit"), (2, None), (3, "miss")], "request_id long, verdict string"), tmp_path / "s")
    writer, name = online.traced(rows, str(tmp_path / "out"), str(tmp_path / "check"))
    q = drained(spark, writer)
    metrics = [p.observedMetrics[name] for p in q.recentProgress if name in p.observedMetrics]
    assert sum(m.records for m in metrics) == 3 and sum(m.lacking for m in metrics) == 1
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_first_token_stream(spark, tmp_path):
    rows = [("a", 1.0, "start"), ("a", 1.25, "token"), ("a", 2.0, "token"), ("b", 5.0, "start")]
    df = spark.createDataFrame(rows, "request string, at double, kind string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    drained(spark, online.first_token(streamed(spark, df, tmp_path / "f"), "request", "ts", "kind").writeStream.format("memory").queryName("first").outputMode("complete"))
    assert {r.request: r.ttft_ms for r in spark.table("first").collect()} == {"a": 250, "b": None}
    assert {r.request: r.ttft_ms for r in trace.first_token(df, "request", "ts", "kind").collect()} == {"a": 250, "b": None}


def test_leg_means_in_any_order(spark):
    """The mean is 55.05 exactly; in floating point some orders sum to less, and round to 55.0."""
    orders = list(itertools.permutations([68.72, 56.28, 90.68, 18.46, 41.11]))
    assert {round(sum(o) / 5, 12) for o in orders} == {55.05} and len({math.fsum(o) / 5 for o in orders}) == 1
    df = spark.createDataFrame([(i, v, v) for i, o in enumerate(orders) for v in o], "leg long, ttft_ms double, tpot_ms double").coalesce(1)
    assert {r.ttft_mean_ms for r in trace.leg_latencies(df, "leg").collect()} == {55.1}
    whole = spark.createDataFrame([("a", 22728.1, 1.0)] + [("a", 1.0, 1.0)] * 425, "leg string, ttft_ms double, tpot_ms double")  # 23153.1 / 426 is less than 54.35 in floating point
    assert 23153.1 / 426 < 54.35 and trace.leg_latencies(whole, "leg").first().ttft_mean_ms == 54.4
    odd = [("nan", 1.0), ("nan", float("nan")), ("inf", float("inf")), ("big", 1e300), ("big", 3e300), ("null", 2.0), ("null", None), ("none", None)]
    means = {r.leg: r.m for r in spark.createDataFrame(odd, "leg string, v double").groupBy("leg").agg(trace.steady_mean(F.col("v")).alias("m")).collect()}
    assert math.isnan(means.pop("nan")) and means == {"inf": float("inf"), "big": 2e300, "null": 2.0, "none": None}


def test_headers_and_stores(spark):
    fp = {"model_id": "m", "tokenizer_hash": "t", "kv_dtype": "f16", "kv_layout_version": 1}
    head = {"fingerprint": fp, "token_count": 2, "tokens": [1, 2], "format_version": 2, "payload_sha256": "00"}
    files = [("ok", wire.encode(head, b"xyz")), ("bits", wire.encode(head | {"fingerprint": fp | {"kv_bits": -1}}, b"")), ("gran", wire.encode(head | {"granularity": 7}, b"")), ("none", wire.encode({k: v for k, v in head.items() if k != "payload_sha256"}, b""))]
    out = {r.name: (r.reject, r.file_bytes) for r in wire.headers(spark.createDataFrame(files, "name string, content binary")).collect()}
    assert {k: v[0] for k, v in out.items()} == {"ok": None, "bits": "header", "gran": "header", "none": "version"} and out["ok"][1] == len(files[0][1])
    faults = wire.segment_faults(spark.createDataFrame([(1, wire.encode_segment([b"a"])), (2, b"XXXX\x01\x00\x00\x00"), (3, b"MCSG\x02\x00\x00\x00"), (4, b"")], "seg long, content binary"))
    assert {r.seg: r.reject for r in faults.collect()} == {1: None, 2: "magic", 3: "version", 4: None}
    blobs = [("k1-01.ckpt", "k1", None, 2, "d"), ("k1-02.ckpt", "k1", None, 2, "d"), ("k2-01.ckpt", "k9", None, 2, "d"), ("old.ckpt", "k3", None, 1, None), ("k4-1.ckpt", "k4", "digest", 2, "d")]
    df = spark.createDataFrame(blobs, "name string, key string, reject string, format_version int, payload_sha256 string")
    assert {r.name: r.state for r in lifecycle.opened(df).collect()} == {"k1-01.ckpt": "superseded", "k1-02.ckpt": "indexed", "k2-01.ckpt": "corrupt", "old.ckpt": "legacy", "k4-1.ckpt": "corrupt"}
    assert {r.state for r in lifecycle.opened(df.where("name = 'old.ckpt'"), trust_legacy=True).collect()} == {"indexed"}


def test_unused_helpers_have_results(spark):
    row = spark.range(1).select(
        policy.settle_reason(F.lit("too_short: 1")).alias("a"), policy.finish_reason(F.lit(3), F.lit(3)).alias("b"), policy.error_class(F.lit(503)).alias("c"),
        trace.suppressed(F.lit(5.0), F.lit(99)).alias("d"), F.lit(True).alias("e"),
        prefix.common_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))).alias("f"),
    ).first()
    assert tuple(row) == ("too_short", "length", "transport", None, True, 1)
    with keys.wrapping(spark):
        made = spark.range(1).select(keys.completion_id(F.array(F.lit(1)).cast("array<bigint>")))
    assert made.first()[0].startswith("chatcmpl-") and len(made.first()[0]) == 41
