"""Payload layouts and chunk-store mutations on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from prefixloom.operators import chunks, layout, segments
from prefixloom.plans import storage

SF = "/root/testdata/sf0.001"
BLOBS = "blob string, payload binary, positions long, spans array<struct<tensor:string,begin:bigint,end:bigint,n_heads:bigint>>"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def grid(heads, positions, unit):
    return b"".join(hashlib.sha256(f"{h}:{p}".encode()).digest()[:unit] for h in range(heads) for p in range(positions))


def blob(positions=130):
    k, v = grid(4, positions, 8), grid(2, positions, 4)
    head = b"header12"
    payload = head + k + b"gap" + v + b"odd-bytes"
    a, b = len(head), len(head) + len(k) + 3
    return payload, [("v", b, b + len(v), 2), ("k", a, a + len(k), 4), ("odd", b + len(v), b + len(v) + 9, 1), ("none", 5, 5, 1)]


def test_token_blocks_and_back(spark):
    payload, spans = blob()
    rows = [("a", payload, 130, spans), ("plain", b"no tensors", 130, None), ("short", payload, 0, spans), ("empty", b"", 5, None), ("null", None, 5, None)]
    out = layout.token_blocks(spark.createDataFrame(rows, BLOBS)).orderBy("blob", "chunk_no").collect()
    a = [r for r in out if r.blob == "a"]
    assert [(r.tensor, r.per_head_len, r.n_heads) for r in a] == [("k", 512, 4), ("k", 512, 4), ("k", 16, 4), ("odd", 9, 1), ("v", 256, 2), ("v", 256, 2), ("v", 8, 2), (None, 8, 1), (None, 3, 1)]
    k = grid(4, 130, 8)
    for r, first in zip(a[:3], (0, 64, 128)):
        assert r.digest == sha(b"".join(k[h * 1040 + first * 8 : h * 1040 + first * 8 + r.per_head_len] for h in range(4))) and (r.first_off, r.head_stride) == (8 + first * 8, 1040)
    assert sum(r.size for r in a) == len(payload)
    assert [(r.blob, r.digest) for r in out if r.blob != "a"] == [("plain", sha(b"no tensors")), ("short", sha(payload))]
    source = {"a": payload, "short": payload, "plain": b"no tensors"}
    bodies = [(r.digest, b"".join(source[r.blob][r.first_off + h * r.head_stride : r.first_off + h * r.head_stride + r.per_head_len] for h in range(r.n_heads))) for r in out]
    refs = [(r.blob, r.digest, r.per_head_len, r.n_heads, r.first_off, r.head_stride, {"a": len(payload), "plain": 10, "short": len(payload)}[r.blob]) for r in out]
    refs += [("lost", "ff", 1, 1, 0, 0, 1), ("twice", refs[-1][1], len(payload), 1, 0, 0, 9999), ("twice", refs[-1][1], len(payload), 1, 5, 0, 9999), ("holes", sha(b"no tensors"), 10, 1, 3, 0, 15)]
    manifest = spark.createDataFrame(refs, "blob string, digest string, per_head_len long, n_heads long, first_off long, head_stride long, payload_len long")
    got = {r.blob: r.payload and bytes(r.payload) for r in layout.scattered(manifest, spark.createDataFrame(bodies, "digest string, body binary")).collect()}
    assert got == {"a": payload, "plain": b"no tensors", "short": payload, "lost": None, "twice": None, "holes": bytes(3) + b"no tensors" + bytes(2)}


def test_ragged(spark):
    payload, spans = blob(131)
    df = spark.createDataFrame([("a", payload, 7, spans)], BLOBS)
    assert {r.tensor: r.n_heads for r in layout.token_blocks(df).collect()} == {"k": 1, "v": 1, "odd": 1, None: 1}
    with pytest.raises(Exception, match="does not divide"):
        layout.token_blocks(df, ragged="fail").collect()


def test_blocks_grow_by_what_is_new(spark):
    """A longer payload moves its heads, and shares all full blocks."""
    rows = []
    for turn, n in enumerate((128, 200, 256)):
        payload = grid(4, n, 8)
        rows.append(("c", turn, f"t{turn}", payload, n, [("k", 0, len(payload), 4)]))
    df = spark.createDataFrame(rows, "convo string, turn int, " + BLOBS)
    per = {r.turn: r.new_bytes for r in chunks.new_bytes_per_turn(layout.token_blocks(df)).collect()}
    assert per == {0: 128 * 32, 1: 72 * 32, 2: 64 * 32}
    whole = {r.turn: r.new_bytes for r in chunks.new_bytes_per_turn(layout.scoped(df, "file", lambda x: chunks.fixed_blocks(x, 1024).withColumn("end_off", F.lit(0)))).collect()}
    assert whole[1] > per[1]


def test_scopes(spark):
    payload, spans = blob()
    df = spark.createDataFrame([("a", payload, 130, spans[:2])], BLOBS)
    assert [(r.tensor, r.head, r.begin, bytes(r.payload)) for r in layout.scopes(df, "file").collect()] == [(None, 0, 0, payload)]
    heads = layout.scopes(df, "head").orderBy("tensor", "head").collect()
    assert [(r.tensor, r.head, bytes(r.payload)) for r in heads] == [("k", h, grid(4, 130, 8)[h * 1040 :][:1040]) for h in range(4)] + [("v", h, grid(2, 130, 4)[h * 520 :][:520]) for h in range(2)]
    cut = layout.scoped(df, "tensor", lambda x: chunks.content_defined(x, 512)).collect()
    assert max(r.end_off for r in cut) == spans[0][2] and sum(r.size for r in cut) == 4160 + 1040
    with pytest.raises(ValueError):
        layout.scopes(df, "page")


def test_stability_counts_cuts_below_the_shared_length(spark):
    rows = [("c", 1, 0, 10, 10), ("c", 1, 0, 25, 15), ("c", 1, 0, 30, 5), ("c", 2, 0, 10, 10), ("c", 2, 0, 26, 16), ("c", 2, 0, 50, 24), ("d", 1, 0, 5, 5)]
    df = spark.createDataFrame(rows, "convo string, turn int, head int, end_off long, size long")
    r = chunks.stability(df, ("convo", "head")).first()
    assert (r.cuts, r.stable, r.stability) == (2, 1, 0.5)
    assert chunks.stability(df.where("convo = 'd'")).first().stability == 1.0


RECORDS = [(1, 8, 100, "a"), (1, 144, 50, "b"), (1, 230, 10, "c"), (2, 8, 100, "a"), (3, 8, 40, "x"), (4, 8, 7, "d")]


def test_sweep(spark):
    records = spark.createDataFrame(RECORDS, "seg long, rec_off long, body_len long, digest string")
    live = spark.createDataFrame([("a",), ("c",), ("d",)], "digest string")
    config = segments.CompactConfig(ratio=0.1, min_dead_bytes=1, max_segments=5)
    after, receipts = segments.compacted(records, live, None, config)
    assert [tuple(r) for r in receipts.select("seg", "new_seg", "moved", "reclaimed").collect()] == [(1, 5, 1, 136 + 86)]
    assert sorted(map(tuple, after.collect())) == [(2, 8, 100, "a"), (3, 8, 40, "x"), (4, 8, 7, "d"), (5, 8, 10, "c")]
    kept, gone = segments.collected(records, live, 3)
    assert gone.count() == 0 and kept.count() == 6
    swept, receipt = segments.swept(records, live, config)
    assert tuple(receipt.first()) == (1, 222, 76) and sorted(r.seg for r in swept.collect()) == [2, 4, 5]
    off, none = segments.compacted(records, live, None, segments.CompactConfig(enabled=False))
    assert none.count() == 0 and off.count() == 6


def test_chunker_grid_sends_its_chunks_once(spark):
    """Seven plans side by side, each with its joins, took over the driver's memory."""
    plan = storage.chunker_grid(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Window ") <= 9


def test_growth_by_several_keys(spark):
    rows = [("x", 1, 0, "a", 5), ("x", 1, 0, "a", 5), ("x", 1, 1, "a", 5), ("x", 1, 1, "b", 3), ("y", 1, 0, "b", 3), ("y", 1, 1, "b", 3), ("y", 2, 0, "a", 5), ("y", None, 0, "a", 5), ("y", 2, 1, None, 9)]
    df = spark.createDataFrame(rows, "config string, convo long, turn long, digest string, size long")
    by = ("config", "convo")
    per = chunks.new_bytes_per_turn(df, by)
    assert sorted(tuple(r) for r in per.collect()) == [("x", 1, 0, 10, 10, 1.0), ("x", 1, 1, 3, 8, 0.375), ("y", 1, 0, 3, 3, 1.0), ("y", 1, 1, 0, 3, 0.0), ("y", 2, 0, 5, 5, 1.0)]
    assert sorted(tuple(r) for r in chunks.mean_new_frac(per, by).collect()) == [("x", 1, 2, 0.375, 13), ("y", 1, 2, 0.0, 3)]


def test_compaction_orders_records_at_one_offset(spark):
    rows = [(1, 50, 10, "c"), (1, 50, 7, "a"), (1, 50, 9, "d"), (1, 50, 8, "b"), (1, 10, 5, "z"), (1, 5, 5, "dead")]
    live = spark.createDataFrame([(x,) for x in "abcdz"], "digest string")
    config = segments.CompactConfig(ratio=0.1, min_dead_bytes=1, max_segments=1)
    for given in (rows, rows[::-1]):
        after = segments.compacted(spark.createDataFrame(given, "seg long, rec_off long, body_len long, digest string"), live, None, config)[0]
        assert sorted(map(tuple, after.collect())) == [(2, 8, 5, "z"), (2, 49, 7, "a"), (2, 92, 8, "b"), (2, 136, 10, "c"), (2, 182, 9, "d")]


def test_staging_fills_segments(spark):
    old = spark.createDataFrame([("a", 10)], "digest string, body_len long")
    new = spark.createDataFrame([(f"n{i:02}", 64) for i in range(20)] * 2 + [("a", 10)], "digest string, body_len long")
    rows = segments.staged(old, new, 308, 3).collect()
    assert sorted(r.digest for r in rows) == [f"n{i:02}" for i in range(20)]
    by = {}
    for r in sorted(rows, key=lambda r: r.digest):
        by.setdefault(r.seg, []).append(r.rec_off)
    assert min(by) == 4 and all(v == [8 + 100 * k for k in range(len(v))] and len(v) <= 4 for v in by.values())


def test_configs():
    c = segments.CompactConfig.parsed({"enabled": "false", "ratio": "0.25", "min_dead_bytes": "x", "max_segments": "-3"})
    assert c == segments.CompactConfig(False, 0.25, 16 << 20, 2)
    assert segments.CompactConfig.parsed({"ratio": "1.5"}) == segments.CompactConfig()
    assert not segments.EvictConfig.parsed().enabled and segments.EvictConfig.parsed(max_entries=3).max_entries == 3
    assert segments.EvictConfig.parsed(max_quarantined=0).enabled
