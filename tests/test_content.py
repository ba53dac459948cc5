"""Canonical JSON and media digests, synthetic tokens, forensics, residual corrections, tensor checks, path recency."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.functions import content, tokens
from prefixloom.operators import forensics, prefix, vectors
from prefixloom.sources import wire


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b": 1, "a": [true, null, "\\u00e9\\n"]}', '{"a":[true,null,"é\\n"],"b":1}'),
        ("[1.0, 0.1, -0.0, 1e15, 1e16, 1.5e300, 0.00001234, 1.25e-6]", "[1.0,0.1,-0.0,1000000000000000.0,1e16,1.5e300,0.00001234,1.25e-6]"),
        ("[18446744073709551615, 18446744073709551616]", "[18446744073709551615,1.8446744073709552e19]"),
        ('{"z": {"y": 1, "x": {}}}', '{"z":{"x":{},"y":1}}'),
    ],
)
def test_canonical(text, want):
    assert content.canonical(json.loads(text)) == want


def said(*contents):
    return json.dumps([{"role": "user", "content": c} for c in contents])


def test_content_digest(spark):
    image = {"type": "image_url", "image_url": {"url": "é"}}
    turned = {"image_url": {"url": "é"}, "type": "image_url"}
    cases = [said("a"), said([{"type": "text", "text": "a"}, "b"], None), said([image]), said([{"type": "text", "text": "other"}, turned]), said([1, 23]), said([12, 3]), said([1], [23]), said({"type": "text"}), None, "no json", said([float("nan")]), "[1]", ""]
    got = [r.d for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", content.content_digest("c").alias("d")).orderBy("i").collect()]
    part = '{"image_url":{"url":"é"},"type":"image_url"}'.encode()
    assert got[:2] == ["", ""] and got[2] == got[3] == hashlib.sha256(b"%d:%b" % (len(part), part)).hexdigest()
    assert got[4] == got[6] == hashlib.sha256(b"1:12:23").hexdigest() != got[5] and len(got[7]) == 64
    assert got[8:] == [None] * 5


def test_composition_and_vocabulary(spark):
    row = spark.createDataFrame([(["A", "B"], '{"b": 1, "a": 0}')], "n array<string>, v string").select(content.composition(F.col("n")), content.vocabulary_hash("v")).first()
    assert row[0] == hashlib.sha256(b"A,B").hexdigest()[:16] and row[1] == hashlib.sha256(repr([("a", 0), ("b", 1)]).encode()).hexdigest()[:16]


def plain(text):
    return [w % 2**31 for w in struct.unpack("<8I", hashlib.sha256(text.encode()).digest())]


def test_synthetic_tokens(spark):
    prompts = ["", "é", '[{"content":"base"}]', '[{"content":"base | one | two"}]', '[{"content":"base tail"}]', "base | one | "]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string")
    rows = df.select("i", tokens.synthetic(F.col("p")).alias("s"), tokens.growing(F.col("p"), "base").alias("g"), tokens.hinge(F.col("p")).alias("h")).orderBy("i").collect()
    for p, r in zip(prompts, rows):
        assert r.s == plain(p) and r.h == struct.unpack("<I", hashlib.sha256(p.encode()).digest()[:4])[0] & 0x7FFFFFFF
    base = plain("base")
    assert [r.g for r in rows] == [plain(""), plain("é"), base, base + plain("one") + plain("two"), base + plain(" tail"), base + plain("one") + plain("")]


def test_synthetic_kv(spark):
    t = [0, 7, 2147483647, 4294967295]
    got = spark.createDataFrame([(t,)], "t array<long>").select(tokens.synthetic_kv(F.col("t"))).first()[0]
    assert bytes(got) == b"".join(struct.pack("<I", (x * 31 + i) & 0xFFFFFFFF) * 256 for i, x in enumerate(t))


def test_first_difference():
    big = bytes(3_000_000)
    assert forensics.first_difference(b"abc", b"abx") == 2 and forensics.first_difference(b"ab", b"abc") is None and forensics.first_difference(b"", b"x") is None
    assert forensics.first_difference(big, big[:2_500_000] + b"\1" + big[:9]) == 2_500_000 and forensics.first_difference(None, b"") is None


def test_heads_compared(spark):
    a, b = b"aabb" + b"ccdd", b"aabbee" + b"ccxdff"
    pairs = spark.createDataFrame([("p", "kv", a, b, 2)], "pair string, tensor string, a binary, b binary, n_heads int")
    heads = forensics.heads_compared(pairs, F.lit(2))
    assert [tuple(r)[2:] for r in heads.orderBy("head").collect()] == [(0, True, None, None), (1, False, 2, 1)]
    assert [tuple(r) for r in forensics.heads_exact(heads).collect()] == [("p", "kv", 2, 1)]


def test_rolled_segments(spark):
    sizes, rows, end = [5, 4, 2, 20, 1], [], 0
    for n in sizes:
        end += n
        rows.append(("m", end, n))
    out = forensics.rolled(spark.createDataFrame(rows, "blob string, end_off long, size long"), 10).orderBy("end_off").collect()
    assert [(r.seg, r.seg_off) for r in out] == [(0, 0), (0, 5), (1, 0), (2, 0), (3, 0)]


def test_residual_correction():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((400, 64)), rng.standard_normal(64)
    words, norm = vectors.encode(x, 2)
    before = vectors.decode(words, norm, 2, 64) @ q
    after = before + vectors.correction(q, *vectors.residual_signs(x, 2), norm)
    true = x @ q
    assert abs(np.polyfit(true, after, 1)[0] - 1) < 0.15 and np.isfinite(after).all()
    # Averaged over sketches, the correction is the residual's own inner product.
    sketches = [np.random.default_rng(seed).standard_normal((64, 64)) for seed in range(300)]
    d, levels, r = 64, vectors.codebook(64, 2), vectors.rotation(64)
    y = x[:3] / np.linalg.norm(x[:3], axis=1, keepdims=True) @ r.T * 8
    level = levels[np.searchsorted((levels[1:] + levels[:-1]) / 2, y)]
    left = np.linalg.norm(level, axis=1, keepdims=True) / 8 * y - level
    mean = np.mean([np.sign(left @ s.T) @ (s @ (r @ q)) * np.sqrt(np.pi / 2) / d * np.linalg.norm(left, axis=1) for s in sketches], axis=0)
    assert np.abs(mean - left @ (r @ q)).max() < 0.4


def tensor_file(header, data):
    text = (header if isinstance(header, str) else json.dumps(header)).encode()
    return struct.pack("<Q", len(text)) + text + data


def test_tensor_faults(spark):
    t = lambda a, b, shape=(2,), dtype="F16": {"dtype": dtype, "shape": list(shape), "data_offsets": [a, b]}
    cases = [
        (tensor_file({"k": t(0, 4), "v": t(4, 8), "__metadata__": {"a": "b"}}, bytes(8)), None),
        (tensor_file({"k": t(0, 0, (0, 3))}, b""), None), (b"", "length"), (None, "length"), (struct.pack("<Q", 99) + b"{}", "length"),
        (tensor_file("{bad", b""), "json"), (tensor_file("[]", b""), "json"), (tensor_file('{"__metadata__":{"a":"\\ud800"}}', b""), "json"), (tensor_file('{"k":NaN}', b""), "json"),
        (tensor_file({"__metadata__": {"a": 1}}, b""), "metadata"), (tensor_file({"k": 1}, b""), "tensor"), (tensor_file({"k": t(0, 4, dtype="X")}, bytes(4)), "dtype"),
        (tensor_file({"k": t(0, 4, (True, 2))}, bytes(4)), "shape"), (tensor_file({"k": t(0, 5)}, bytes(5)), "offsets"), (tensor_file({"k": t(0, 4)}, bytes(3)), "offsets"),
        (tensor_file({"k": t(0, 4), "v": t(2, 6)}, bytes(6)), "overlap"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, payload binary")
    assert [r.f for r in df.select("i", wire.tensor_faults("payload").alias("f")).orderBy("i").collect()] == [w for _, w in cases]
    (row,) = wire.tensors(df.where("i = 1"), "i").collect()
    assert (row.tensor, row.dtype, list(row["shape"]), row.end - row.begin, row.n_heads) == ("k", "F16", [0, 3], 0, 3)


def test_touched_path(spark):
    entries = spark.createDataFrame([(n, "e", "f", t, g, 0) for n, t, g in [("a", [1, 2], 0), ("b", [1, 2, 3], 0), ("w", [1, 2, 3], 1), ("x", [1, 2, 9], 0)]], "name string, engine string, fp string, tokens array<long>, granularity int, last_used long")
    requests = spark.createDataFrame([(1, "e", "f", [1, 2, 3, 4]), (2, "e", "f", [1, 2, 3]), (3, "e", "f", [1, 2, 7]), (4, "o", "f", [1, 2, 3])], "request_id long, engine string, fp string, tokens array<long>")
    got = dict(map(tuple, prefix.touched(requests, entries, "request_id").collect()))
    assert got == {"a": 3, "b": 3, "w": 2}
