"""Golden keys, hand-computed matches, wire round trips, quantiser and stream checks."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.functions import keys
from prefixloom.operators import chunks, policy, prefix, vectors
from prefixloom.sources import wire

FP = {"model_id": "golden-model", "tokenizer_hash": "golden-tok", "kv_dtype": "f16", "kv_layout_version": "1"}


@pytest.mark.parametrize(
    "engine, extra, tokens, want",
    [
        (None, {}, 8, "2786690f2948dec17c5498a6267fc101"),
        (None, {}, 0, "ca1873d2c14a2fe1f6be3cc0354ea7e9"),
        ("llama-cpp", {}, 8, "0f8b99131596e10dfed791048839d6e5"),
        (None, {"cache_layout": "KV-KV"}, 8, "e21b343efc207f88a45df7f9530fbe62"),
        ("llama-cpp", {"cache_layout": "KV-KV"}, 8, "01d9e1aadc1b180c8d8580d70683df4e"),
        (None, {"content_digest": "b1946ac92492d2347c6235b4d2611184"}, 8, "831a3b8ca657914f65c4de75cf8a4a61"),
        (None, {"kv_tier": "tq-k3v4-g64"}, 8, "65b2e486a06841393d8af583c8216377"),
    ],
)
def test_golden_keys(spark, engine, extra, tokens, want):
    with keys.wrapping(spark):
        t = F.array(*[F.lit(i) for i in range(1, tokens + 1)]).cast("array<bigint>")
        key = keys.blob_key({k: F.lit(v) for k, v in (FP | extra).items()}, F.lit(engine).cast("string"), t)
        df = spark.range(1).select(key)
    assert df.first()[0] == want


@pytest.mark.parametrize(
    "entries, request_, entry, matched, verdict",
    [
        ([([1, 2], 0), ([1, 2, 3, 4], 0)], [1, 2, 3, 4, 5], 1, 4, "partial"),
        ([([1, 2], 0), ([1, 2, 3, 4], 0)], [1, 2, 3, 4], 1, 4, "hit"),
        ([([1, 2], 0), ([1, 2, 3, 4], 0)], [1, 2, 3, 9], 1, 4, "hit"),
        ([([1, 2], 0), ([1, 2, 3, 4], 0)], [1, 2, 3], 0, 2, "partial"),
        ([([1, 2, 3, 4], 0)], [1, 2, 9, 4], None, 0, "miss"),
        ([([1, 2, 3], 0), ([1, 2, 9], 0)], [1, 2, 3, 7], 0, 3, "partial"),
        ([([1, 2, 3], 1), ([1, 2], 0)], [1, 2, 3, 4], 1, 2, "partial"),
        ([([1, 2, 3], 1)], [1, 2, 3], 0, 3, "hit"),
        ([([7], 0)], [7], None, 0, "miss"),
    ],
)
def test_matches(spark, entries, request_, entry, matched, verdict):
    e = spark.createDataFrame([(f"n{i}", "e", "f", t, g, 0) for i, (t, g) in enumerate(entries)] + [("x", "other", "f", request_, 0, 0)], "name string, engine string, fp string, tokens array<long>, granularity int, last_used long")
    r = spark.createDataFrame([(1, "e", "f", request_)], "request_id long, engine string, fp string, tokens array<long>")
    (row,) = policy.classified(prefix.matches(r, e)).collect()
    assert (row.entry, row.matched_tokens, row.verdict) == (None if entry is None else f"n{entry}", matched, verdict)
    assert row.prefill_from == max(0, matched - 1)


def brute_match(request, entries):
    """entries: (name, engine, fp, tokens, granularity, last_used)."""
    best = None
    for name, engine, fp, t, whole, used in entries:
        k, q = len(t), request[3]
        if (engine, fp) != request[1:3] or k < 2 or len(q) < k or q[: k - 1] != t[:-1]:
            continue
        on = q[k - 1] == t[-1]
        if whole and not (on and k == len(q)):
            continue
        rank = (-k, not on, -used, t[-1], name)
        best = min(best or rank, rank)
    return (None, 0, None) if best is None else (best[4], -best[0], not best[1])


def brute_lcp(requests):
    out = {}
    for seq, t in requests:
        out[seq] = max((next((i for i, (a, b) in enumerate(zip(t, u)) if a != b), min(len(t), len(u))) for s, u in requests if s < seq), default=0)
    return out


def test_matches_anchors_and_common_prefixes_over_blocks(spark):
    """Prompts of many blocks that part at all kinds of places, block edges included."""
    rng = np.random.default_rng(7)
    trunk = rng.integers(0, 9, 400).tolist()
    made = []
    for _ in range(160):
        k = int(rng.choice([1, 2, 3, 63, 64, 65, 66, 127, 128, 129, 130, 192, 300, int(rng.integers(1, 400))]))
        t = trunk[:k]
        kind = int(rng.integers(0, 4))
        t = t if kind == 0 else [*t[:-1], 77] if kind == 1 else [*t, *rng.integers(0, 9, int(rng.integers(0, 70))).tolist()] if kind == 2 else [5, *t[1:]]
        made.append(t)
    entries = [(f"n{i:03}", f"e{i % 2}", "f", t, int(i % 11 == 0), i // 3) for i, t in enumerate(made[:90])]
    requests = [(i, f"e{i % 2}", "f", t) for i, t in enumerate(made[60:])] + [(500, "e0", "missing", trunk), (501, "e0", "f", [])]
    e = spark.createDataFrame(entries, "name string, engine string, fp string, tokens array<long>, granularity int, last_used long")
    r = spark.createDataFrame(requests, "request_id long, engine string, fp string, tokens array<long>")
    got = {x.request_id: (x.entry, x.matched_tokens, x.on_path) for x in prefix.matches(r, e).collect()}
    assert got == {q[0]: brute_match(q, entries) for q in requests} and sum(v[1] > 64 for v in got.values()) > 20
    anchors = {x.name for x in prefix.with_anchor(e).collect() if x.is_anchor}
    assert anchors == {a[0] for a in entries if any(len(b[3]) > len(a[3]) and b[3][: len(a[3])] == a[3] for b in entries)}
    lcp = {x.request_id: x.declared_lcp for x in prefix.declared_lcp(r.withColumn("g", F.lit(1)), "g", "request_id").collect()}
    assert lcp == brute_lcp([(q[0], q[3]) for q in requests])
    assert {x.name for x in prefix.exact(e, r).collect()} == {a[0] for a in entries if any(a[3] == q[3] for q in requests)}


def test_semantics_and_gate(spark):
    schema = "name string, engine string, fp string, tokens array<long>, granularity int, last_used long, generation long"
    e = spark.createDataFrame([("a", "e", "f", [1, 2, 3], 0, 9, 1), ("b", "e", "g", [1, 2, 3], 0, 1, 2), ("c", "e", "f", [1, 2], 0, 0, 1)], schema)
    r = spark.createDataFrame([(1, "e", "f", [1, 2, 3, 4])], "request_id long, engine string, fp string, tokens array<long>")
    name = lambda **how: prefix.matches(r, e, **how).first().entry
    assert (name(), name(semantics="daemon"), name(fingerprint_gate=False), name(semantics="daemon", fingerprint_gate=False)) == ("a", "c", "a", "b")
    with pytest.raises(ValueError):
        prefix.matches(r, e, semantics="other")
    out = prefix.arbitrated(r, e.where("name = 'c'"), e.where("name = 'a'")).first()
    assert (out.source, out.entry, out.covered) == ("disk", "a", 2)
    out = prefix.arbitrated(r, e.where("name = 'a'"), e.where("name = 'a'")).first()
    assert (out.source, out.entry) == ("memory", "a")


def test_blob_round_trip(spark):
    payload = b"payload" * 3
    head = {"fingerprint": FP | {"kv_layout_version": 1}, "token_count": 2, "tokens": [1, 4294967295], "format_version": 2, "payload_sha256": hashlib.sha256(payload).hexdigest().upper()}
    good = wire.encode(head, payload)
    files = [(1, good), (2, wire.encode(head, payload + b"!")), (3, wire.encode(head | {"format_version": 9}, payload)), (4, b"xx"), (5, wire.encode(head | {"token_count": 3}, payload)), (6, struct.pack("<I", 5) + b"{bad}")]
    out = {r.id: r for r in wire.decoded(spark.createDataFrame(files, "id long, content binary")).collect()}
    assert [out[i].reject for i in range(1, 7)] == [None, "digest", "version", "header", "tokens", "header"]
    assert bytes(out[1].payload) == payload and out[1].tokens == [1, 4294967295]


def test_segments_and_manifests(spark):
    data = wire.encode_segment([b"abc", b"", b"defg"])
    rows = wire.segments(spark.createDataFrame([(1, data[:-1]), (2, b"MCSG"), (3, data)], "seg long, content binary")).collect()
    assert [(r.seg, r.rec_off, r.body_len) for r in rows] == [(1, 8, 3), (1, 47, 0), (3, 8, 3), (3, 47, 0), (3, 83, 4)]
    assert rows[0].digest == hashlib.sha256(b"abc").hexdigest()


def test_manifest_round_trip(spark):
    refs = [(hashlib.sha256(b"a").digest(), 4, 2, 16, 64), (hashlib.sha256(b"b").digest(), 1, 1, 5_000_000_000, 0)]
    size = 5_000_000_001  # the end of the last reference: a manifest covers its payload
    files = [("m", wire.encode_manifest(size, refs)), ("none", wire.encode_manifest(0, [])), ("cut", wire.encode_manifest(size, refs)[:-1]), ("long", wire.encode_manifest(size + 1, refs))]
    files += [("short", wire.encode_manifest(99, refs)), ("magic", b"XXXX" + wire.encode_manifest(0, [])[4:]), ("v9", b"MCKM" + struct.pack("<HQQ", 9, 0, 0)), ("flat", wire.encode_manifest(4, [(bytes(32), 4, 0, 0, 0)])), ("tiny", b"MC")]
    faults = {r.blob: r.reject for r in wire.manifest_faults(spark.createDataFrame(files, "blob string, content binary"), "blob").collect()}
    assert faults == {"m": None, "none": None, "cut": "truncated", "long": "coverage", "short": "placement", "magic": "magic", "v9": "version", "flat": "geometry", "tiny": "magic"}
    rows = wire.manifests(spark.createDataFrame(files, "blob string, content binary"), "blob").orderBy("chunk_no").collect()
    assert [(r.blob, r.chunk_no, bytes.fromhex(r.digest), r.per_head_len, r.n_heads, r.first_off, r.head_stride, r.payload_len) for r in rows] == [("m", i, *x, size) for i, x in enumerate(refs)]


def test_content_defined_chunks():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    gear = chunks.gear_table()
    ends = chunks.cut(data, 1024, gear)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= 4096 and sizes[:-1].min() >= 256
    longer = chunks.cut(data + bytes(5000), 1024, gear)
    assert longer[: len(ends) - 1] == ends[:-1] and chunks.cut(b"", 1024, gear) == []


def test_codebook_and_codes():
    assert vectors.codebook(128, 1) == pytest.approx([-0.7979, 0.7979], abs=0.01)
    assert vectors.codebook(128, 2) == pytest.approx([-1.51, -0.453, 0.453, 1.51], abs=0.02)
    x = np.random.default_rng(2).standard_normal((50, 64))
    for bits, floor in ((3, 0.97), (4, 0.99)):
        words, norm = vectors.encode(x, bits)
        y = vectors.decode(words, norm, bits, 64)
        cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
        assert cos.mean() > floor
    assert (vectors.unpack(vectors.pack(np.arange(130)[None] % 8, 3), 3, 130) == np.arange(130) % 8).all()
