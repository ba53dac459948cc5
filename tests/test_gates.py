"""Gates, settlement checks, percentiles under ties, the store and SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import register
from prefixloom.operators import gates, lifecycle, trace
from prefixloom.operators.store import Store


def test_agreement(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 3]), (2, [1, 2], [1, 9, 3]), (3, [], []), (4, [1], [1, 2])], "i int, a array<int>, b array<int>")
    got = {r.i: (round(r.agreement, 3), r.first_divergence) for r in gates.agreement(df, "a", "b").collect()}
    assert got == {1: (1.0, None), 2: (0.333, 1), 3: (0.0, None), 4: (0.5, 1)}
    texts = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("", "x"), (None, "x")], "a string, b string").select(gates.divergence_char(F.col("a"), F.col("b")))
    assert [r[0] for r in texts.collect()] == [2, None, None, None]


def test_reuse_gate(spark):
    cols = "run string, identical boolean, measured boolean, disk_hits int, reuse_errors int, tokens_reused int, tokens_total int"
    rows = [("ok", True, False, None, None, 0, 0), ("ok", True, True, 2, 0, 95, 100), ("low", True, True, 1, 0, 50, 100), ("bad", False, True, 0, 1, 0, 0)]
    got = {r.run: (r.ok, list(r.reasons)) for r in gates.reuse_gate(spark.createDataFrame(rows, cols), "run").collect()}
    assert got == {"ok": (True, []), "low": (False, ["skip"]), "bad": (False, ["divergence", "skip", "no_disk_hit", "reuse_errors"])}


def test_sweep_refusals(spark):
    cols = "run string, size long, tokens long, prefill_s double, decode_s double, swap_before_mb double, swap_after_mb double, peak_rss_mb double, control boolean, attempt int"
    row = lambda run, size, prefill, decode=0.1, tokens=None, after=0.0, rss=100.0, control=False, attempt=0: (run, size, tokens or size, prefill, decode, 0.0, after, rss, control, attempt)
    rows = [
        row("good", 8, 1.0), row("good", 16, 2.0), row("good", 8, 1.0, control=True), row("good", 8, 1.2, control=True, attempt=1),
        row("bad", 8, 3.0), row("bad", 16, 2.0, 0.9), row("bad", 8, 1.0, control=True), row("bad", 8, 1.5, control=True, attempt=1),
        row("odd", 8, 1.0, tokens=7), row("odd", 16, 0.0), row("odd", 32, 9.0, after=300.0), row("odd", 64, 20.0, after=300.0, rss=700.0),
    ]
    got = sorted((r.run, r.size or 0, r.reason) for r in gates.sweep_refusals(spark.createDataFrame(rows, cols), "run").collect())
    assert got == [("bad", 0, "decode_grew_more"), ("bad", 8, "not_repeatable"), ("bad", 8, "slower_than_larger"), ("odd", 8, "slower_than_larger"), ("odd", 8, "token_count"), ("odd", 16, "unmeasurable"), ("odd", 32, "swap_growth")]


def test_settle_refusal(spark):
    df = spark.createDataFrame([(0, [1], "t", 1), (1, None, "t", 1), (2, [1, 2], "missing", 1), (3, [1, 2, 3, 4], "t", 1), (4, [1, 2], "t", 0), (5, [1, 2], "t", 99), (6, [1, 2], "t", 1)], "i int, tokens array<int>, tokenizer_hash string, payload_bytes long")
    got = [r.r for r in df.select("i", gates.settle_refusal(3, 50).alias("r")).orderBy("i").collect()]
    assert got == ["too_short", "too_short", "identity_unavailable", "token_cap", "empty_payload", "size_cap", None]
    assert [r.r for r in df.where("i IN (3, 5)").select(gates.settle_refusal(None, None).alias("r")).collect()] == [None, None]


def test_usable(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2, 9], 3), (2, [1, 2, 3], [1, 5, 3], 3), (3, [1, 2], [1, 2], 3), (4, [1], [1], 1)], "i int, e array<int>, r array<int>, m int")
    assert [x.u for x in df.select("i", gates.usable(F.col("e"), F.col("r"), F.col("m")).alias("u")).orderBy("i").collect()] == [True, False, False, False]


@pytest.mark.parametrize("buckets", [1, 8])
def test_percentiles_under_ties_and_a_hot_group(spark, buckets):
    rows = [("hot", float(v // 50)) for v in range(1000)] + [("one", 3.0), ("nulls", None), (None, 1.0)]
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        got = {r.k: tuple(r)[1:] for r in trace.pct_index(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], {"a": 0.0, "b": 0.5, "c": 0.951, "d": 1.0}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    values = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": (values[0], values[500], values[951], values[999], 1000), "one": (3.0, 3.0, 3.0, 3.0, 1)}


def test_quarantine_excess(spark):
    df = spark.createDataFrame([(f"n{i}", "quarantined" if i % 4 else "published", i % 5) for i in range(20)], "name string, state string, last_used int")
    want = sorted((i % 5, f"n{i}") for i in range(20) if i % 4)[:5]
    assert [(r.last_used, r.name) for r in lifecycle.quarantine_excess(df, 10).orderBy("rank").collect()] == want
    assert not lifecycle.quarantine_excess(df, 99).count()


def test_store(spark):
    entry = "name string, engine string, fp string, tokens array<long>, granularity int, last_used long, size_bytes long, generation long"
    empty = Store(spark.createDataFrame([], entry), spark.createDataFrame([], "name string, payload binary"))
    rows = [("a", "e", "f", [1, 2], 0, 1, 10, 1), ("b", "e", "f", [1, 2, 3], 0, 2, 20, 1), ("b2", "e", "f", [1, 2, 3], 0, 3, 20, 2), ("s", "e", "f", [7], 0, 1, 5, 1), ("m", "e", "missing", [1, 2], 0, 1, 5, 1)]
    full = empty.put(spark.createDataFrame(rows, entry), spark.createDataFrame([(r[0], r[0].encode()) for r in rows], "name string, payload binary"))
    assert sorted(r.name for r in full.entries.collect()) == sorted(r.name for r in full.payloads.collect()) == ["a", "b2"]
    requests = spark.createDataFrame([(1, "e", "f", [1, 2, 3, 4]), (2, "e", "missing", [1, 2])], "request_id long, engine string, fp string, tokens array<long>")
    got = {r.request_id: (r.entry, r.verdict, r.payload and bytes(r.payload)) for r in full.fetch(full.lookup(requests)).collect()}
    assert got == {1: ("b2", "partial", b"b2"), 2: (None, "miss", None)}
    assert [r.name for r in full.invalidate([1, 2, 3]).entries.collect()] == ["a"] and not full.invalidate([]).payloads.count()
    assert [r.name for r in full.within(15, 100, 0).entries.collect()] == ["a"]


def test_sql_functions(spark):
    names = register.register(spark, "px_")
    assert "px_content_digest" in names
    row = spark.sql("""SELECT px_canonical_json('{"b":1,"a":2.0}') AS c, px_first_diff(X'0102', X'0103') AS d, px_tensor_fault(X'00') AS t""").first()
    assert (row.c, row.d, row.t) == ('{"a":2.0,"b":1}', 1, "length") and json.loads(row.c)["a"] == 2


def test_a_new_fingerprint_replaces_the_old_one_in_a_domain(spark):
    entry = "name string, engine string, fp string, tokens array<long>, generation long"
    old = spark.createDataFrame([("a", "e", "f1", [1, 2], 1), ("o", "other", "f1", [1, 2], 1)], entry)
    new = spark.createDataFrame([("b", "e", "f2", [1, 2], 2)], entry)
    assert sorted(r.name for r in lifecycle.publish(old, new, "engine", "tokens").collect()) == ["b", "o"]
    assert sorted(r.name for r in lifecycle.publish(old, new, "engine", "fp", "tokens").collect()) == ["a", "b", "o"]
