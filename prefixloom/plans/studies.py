"""Queries over traces, workloads, vector tiers, captures and event lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import adapter, content
from ..operators import chunks as ch
from ..operators import forensics, gates, layout, policy, prefix, trace, vectors, workloads
from ..sources import published
from . import inputs as i
from .registry import query
from .storage import head_major

# Traces


@query("SELECT event_type, median(value) AS median, round(avg(value), 1) AS mean, count(value) AS n FROM events GROUP BY event_type")
def median_latency(spark, d):
    return trace.medians(i.table(spark, d, "events"), "value", "event_type")


_LEG = "SELECT user_id, s[round_even(0.5 * (len(s) - 1), 0)::INT + 1] AS ttft_p50_ms, CASE WHEN len(s) >= 100 THEN s[round_even(0.95 * (len(s) - 1), 0)::INT + 1] END AS ttft_p95_ms, len(s)::BIGINT AS n, q[round_even(0.5 * (len(q) - 1), 0)::INT + 1] AS tpot_p50_ms, round(m, 1) AS ttft_mean_ms"


@query(f"{_LEG} FROM (SELECT user_id, list_sort(list(value)) AS s, list_sort(list(value * (1 + event_id % 7))) AS q, avg(value) AS m FROM events GROUP BY user_id)")
def leg_latencies(spark, d):
    e = i.table(spark, d, "events").select("user_id", F.col("value").alias("ttft_ms"), (F.col("value") * (1 + F.col("event_id") % 7)).alias("tpot_ms"))
    return trace.leg_latencies(e, "user_id")


_AGREE = f"{i.ROUTED}, s AS (SELECT turn % 3 AS leg, count(*) AS samples, sum(n_tokens)::BIGINT AS samples_tokens, sum(prefill_from)::BIGINT AS samples_served FROM routed GROUP BY 1), r AS (SELECT turn % 3 AS leg, count(*) AS records, sum(n_tokens)::BIGINT AS tokens_total, sum(CASE WHEN turn = 4 THEN prefill_from + 1 ELSE prefill_from END)::BIGINT AS tokens_reused FROM routed WHERE turn <> 5 GROUP BY 1)"


@query(f"WITH {_AGREE} SELECT leg, samples, samples_tokens, samples_served, records, tokens_total, tokens_reused, samples = records AND samples_tokens = tokens_total AND samples_served = tokens_reused AS agrees FROM s JOIN r USING (leg)")
def score_agreement(spark, d):
    """Samples beside a trace that lost one turn's records and counts another's wrongly."""
    r = policy.classified(prefix.matches(i.requests(spark, d), i.entries(spark, d))).withColumn("leg", F.col("turn") % 3)
    s = r.select("leg", F.col("n_tokens").alias("prompt_tokens"), F.col("prefill_from").alias("served"))
    records = r.where("turn <> 5").withColumn("prefill_from", F.col("prefill_from") + F.when(F.col("turn") == 4, 1).otherwise(0))
    return trace.score_agreement(s, records, "leg")


@query("SELECT event_type AS phase, count(value) AS runs, round(sum(value), 4) AS total_s, round(avg(value), 4) AS mean_s FROM events GROUP BY event_type")
def phase_timers(spark, d):
    p = trace.phases(i.table(spark, d, "events"), "event_type", "value")
    return p.select(F.col("event_type").alias("phase"), "runs", F.round("total_s", 4).alias("total_s"), F.round("mean_s", 4).alias("mean_s"))


@query("SELECT doc_id, round(octet_length(encode(text)) / greatest(len(string_split(text, ' ')), 1), 1) AS per_token FROM documents")
def bytes_per_token(spark, d):
    return i.table(spark, d, "documents").select("doc_id", trace.per_token(F.octet_length("text"), F.size(F.split("text", " "))).alias("per_token"))


@query("SELECT event_id // 10 AS request, min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'click') - min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'view') AS ttft_ms FROM events GROUP BY 1")
def first_token(spark, d):
    kind = F.when(F.col("event_type") == "click", "token").when(F.col("event_type") == "view", "start")
    ts = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    e = i.table(spark, d, "events").select(F.floor(F.col("event_id") / 10).cast("long").alias("request"), ts.alias("ts"), kind.alias("kind"))
    return trace.first_token(e, "request", "ts", "kind")


@query(
    "WITH s AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT user_id, event_id FROM s WHERE value < previous"
)
def monotonicity_breaks(spark, d):
    return trace.monotonic_breaks(i.table(spark, d, "events"), "event_id", "value", ["user_id"]).select("user_id", "event_id")


@query(
    f"WITH {i.ROUTED} SELECT a.conv_id, a.turn, (SELECT count(*) FROM unnest(range(1, least(len(a.tokens), len(b.tokens)) + 1)) u(x) WHERE a.tokens[1:x] = b.tokens[1:x])::BIGINT AS shared FROM requests a JOIN requests b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"
)
def next_turn_prefix(spark, d):
    """The common prefix of each request with the next of its conversation."""
    r = i.requests(spark, d).select("conv_id", "turn", "tokens")
    j = r.withColumn("next", F.lead("tokens").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next IS NOT NULL")
    return j.select("conv_id", "turn", prefix.common_prefix(F.col("tokens"), F.col("next")).alias("shared"))


# Workloads

TEXT = "You are a careful assistant. " + "Cache entries are kept as long as they are used, and leave by size. " * 6


@query()
def workloads_built(spark, d):
    """Every workload's requests and their words."""
    w = [workloads.shared_prefix(spark, TEXT, 6), workloads.shared_prefix(spark, TEXT, 6, primed=False), workloads.near_miss(spark, TEXT, 6), workloads.long_answers(spark, 6)]
    out = w[0]
    for more in w[1:]:
        out = out.unionByName(more)
    return out.select("workload", "seq", "label", "max_tokens", F.size(workloads.words()).alias("n_words"))


@query()
def pressure_sweep(spark, d):
    """What is left of a prefix after unrelated requests under a cap of three entries."""
    return workloads.under_pressure(workloads.pressure(spark, TEXT, [0, 1, 2, 4, 8, 16]))


# Layout of tensors


@query("SELECT 'k' AS tensor, 4 AS least, 4 AS most, '0' AS remainders")
def layout_summary(spark, d):
    """Bytes of a position by tensor over all payloads, and what doesn't divide."""
    h = head_major(spark, d).select("positions", F.explode("spans").alias("s")).select("positions", "s.*").where("tensor = 'k'")
    out = forensics.layout(h, F.col("positions"))
    return out.select("tensor", F.col("least").cast("int").alias("least"), F.col("most").cast("int").alias("most"), F.array_join(F.transform("remainders", lambda x: x.cast("string")), ",").alias("remainders"))


@query("WITH t AS (SELECT conv_id AS convo, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT convo, turn, true AS same_names, true AS holds FROM t WHERE before IS NOT NULL")
def tensor_sets(spark, d):
    """Each turn's tensor names beside the turn before: equal, and none lost."""
    names = F.array_sort(F.transform("spans", lambda s: s["tensor"]))
    h = head_major(spark, d).select("convo", "turn", names.alias("names"))
    before = F.lag("names").over(Window.partitionBy("convo").orderBy("turn"))
    j = h.withColumn("before", before).where("before IS NOT NULL")
    return j.select("convo", "turn", (F.col("names") == F.col("before")).alias("same_names"), (F.size(F.array_except("before", "names")) == 0).alias("holds"))


@query(
    "WITH a AS (SELECT doc_id, list_transform(string_split(text, ' ')[1:2 + doc_id % 3], lambda w: length(w)) AS w FROM documents), p AS (SELECT a.doc_id, a.w, b.w AS v FROM a JOIN a b ON b.doc_id = a.doc_id + 1)"
    " SELECT doc_id, len(w) AS n FROM p WHERE len(list_filter(w, lambda x: NOT list_contains(v, x))) = 0"
)
def contained_sets(spark, d):
    """Documents whose first words' lengths are a subset of the next one's."""
    w = F.transform(F.slice(F.split("text", " "), F.lit(1), (F.col("doc_id") % 3 + 2).cast("int")), lambda x: F.length(x))
    a = i.table(spark, d, "documents").select("doc_id", w.alias("w"))
    j = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    return j.where(F.size(F.array_except("w", "v")) == 0).select("doc_id", F.size("w").cast("long").alias("n"))


@query(f"WITH {i.CHUNKS}, rc AS (SELECT digest, count(DISTINCT blob) AS blobs, max(size) AS size FROM chunks GROUP BY digest), o AS (SELECT DISTINCT blob, digest FROM chunks) SELECT blob, row_number() OVER (ORDER BY blob) AS place, coalesce(sum(size + 36) FILTER (WHERE blobs = 1), 0)::BIGINT AS unique_bytes FROM o JOIN rc USING (digest) GROUP BY blob ORDER BY blob LIMIT 100")
def share_by_name(spark, d):
    """The first hundred blobs by name, and what each holds alone: a report."""
    s = ch.share_blobs(ch.fixed_blocks(i.payloads(spark, d), 256)).orderBy("blob").limit(100)
    return s.select("blob", F.row_number().over(Window.orderBy("blob")).cast("long").alias("place"), "unique_bytes")


@query("SELECT blob, (n * 4 + 13)::BIGINT AS bytes, ((n + 63) // 64 + 2)::BIGINT AS chunks, round((n * 4 + 13) / n, 2) AS bytes_per_position, true AS same FROM (SELECT 'c' || conv_id || '-t' || turn AS blob, sum(2 * octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def round_trips(spark, d):
    """Payloads cut into blocks of positions and put together again."""
    return layout.round_trip(head_major(spark, d).select("blob", "payload", "positions", "spans"))


_ROLL = f"""{i.CHUNKS}, s AS (SELECT blob, chunk_no, 40 + (chunk_no * 7919 + 13 * turn) % 160 AS size FROM chunks),
placed AS (SELECT blob, chunk_no, size, 0 AS seg, 0 AS seg_off FROM s WHERE chunk_no = 0 UNION ALL
  SELECT s.blob, s.chunk_no, s.size, CASE WHEN p.seg_off + p.size + s.size > 600 THEN p.seg + 1 ELSE p.seg END, CASE WHEN p.seg_off + p.size + s.size > 600 THEN 0 ELSE p.seg_off + p.size END FROM placed p JOIN s ON s.blob = p.blob AND s.chunk_no = p.chunk_no + 1)"""


def uneven(spark, d):
    """Chunks of uneven sizes, a gap of five bytes before each."""
    c = ch.fixed_blocks(i.payloads(spark, d), 256)
    size = (40 + (F.col("chunk_no") * 7919 + 13 * F.col("turn")) % 160).cast("long")
    ahead = F.sum("size").over(Window.partitionBy("blob").orderBy("chunk_no"))
    return c.select("blob", "chunk_no", size.alias("size")).withColumn("end_off", ahead + 5 * (F.col("chunk_no") + 1))


@query(f"WITH RECURSIVE {_ROLL} SELECT blob, (sum(size) OVER (PARTITION BY blob ORDER BY chunk_no) - size + 5 * (chunk_no + 1))::BIGINT AS start, size::BIGINT AS size, seg::BIGINT AS seg, seg_off::BIGINT AS seg_off FROM placed")
def packed_chunks(spark, d):
    """Chunks in order, packed greedily into segments of 600 bytes."""
    c = uneven(spark, d)
    return forensics.materialised(c, c.groupBy("blob").agg(F.max("end_off").alias("payload_len")), 600)[0]


@query(f"WITH RECURSIVE {_ROLL}, e AS (SELECT blob, chunk_no, (sum(size) OVER (PARTITION BY blob ORDER BY chunk_no) - size + 5 * (chunk_no + 1))::BIGINT AS start FROM placed) SELECT blob, start - 5 AS gap_start, start AS gap_end FROM e")
def inline_spans(spark, d):
    """Bytes between chunks, kept inline."""
    c = uneven(spark, d)
    return forensics.materialised(c, c.groupBy("blob").agg(F.max("end_off").alias("payload_len")), None)[1]


@query(
    f"WITH {i.ROUTED}, j AS (SELECT r.request_id, CASE WHEN r.conv_id % 5 = 0 THEN e.tokens[1:1] ELSE e.tokens END AS t, r.tokens AS q, r.turn FROM requests r JOIN entries e ON e.conv_id = r.conv_id AND e.turn = r.turn - 1 + r.conv_id % 3)"
    " SELECT request_id, CASE WHEN len(t) < 2 OR len(t) > len(q) THEN 'unusable' WHEN t[1:len(t) - 1] <> q[1:len(t) - 1] OR turn % 6 = 5 THEN 'rejected' ELSE 'usable' END AS state FROM j"
)
def checkpoint_usability(spark, d):
    """A restored checkpoint against the request that wants it."""
    e = i.entries(spark, d).select("conv_id", F.col("turn").alias("at"), F.when(F.col("conv_id") % 5 == 0, F.slice("tokens", 1, 1)).otherwise(F.col("tokens")).alias("t"))
    r = i.requests(spark, d)
    j = r.join(e, "conv_id").where(F.col("at") == F.col("turn") - 1 + F.col("conv_id") % 3)
    return j.select("request_id", gates.usability(F.col("t"), F.col("tokens"), F.when(F.col("turn") % 6 == 5, 0).otherwise(10), F.lit(True)).alias("state"))


@query(f"WITH {i.ROUTED} SELECT request_id, n_tokens, 'miss' AS verdict, 0::BIGINT AS prefill_from FROM routed")
def scratch_decisions(spark, d):
    return policy.from_scratch(i.requests(spark, d)).select("request_id", "n_tokens", "verdict", "prefill_from")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (props ->> '$.k')::BIGINT END AS k FROM events")
def json_fields(spark, d):
    """A number of each event's properties; every fourth text is cut off."""
    text = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return i.table(spark, d, "events").select("event_id", content.scanned(text, "$.k", "bigint").alias("k"))


@query("SELECT conv_id, turn, list_sum(list_transform(string_split(text, ' '), lambda w: length(w)))::BIGINT AS total FROM conversations")
def adapted_tokens(spark, d):
    """Token ids by a tokenizer that is brought along: here the lengths of words."""
    ids = adapter.tokens(lambda text: [len(w) for w in text.split(" ")], F.col("text"))
    return i.table(spark, d, "conversations").select("conv_id", "turn", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# Captures and event lines

_NAMED = "SELECT conv_id AS chain, turn, list('c' || conv_id || '-' || turn // (1 + conv_id % 2)) OVER (PARTITION BY conv_id ORDER BY turn) AS names FROM conversations"


@query(
    f"WITH n AS ({_NAMED}), r AS (SELECT chain, turn, unnest(names) AS name FROM n), f AS (SELECT chain, name, min(turn) AS turn FROM r GROUP BY ALL), a AS (SELECT chain, turn, list_sort(list(name)) AS new FROM f GROUP BY ALL),"
    " j AS (SELECT n.chain, n.turn, coalesce(a.new, []) AS new, row_number() OVER (PARTITION BY n.chain ORDER BY n.turn) AS i FROM n LEFT JOIN a ON a.chain = n.chain AND a.turn = n.turn)"
    " SELECT chain, turn, array_to_string(new, ',') AS new, CASE WHEN i > 1 AND len(new) <> 1 THEN len(new) || ' new names' END AS problem FROM j"
)
def capture_growth(spark, d):
    """What each turn adds to a store: every other conversation adds to it in every second turn only."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / (1 + F.col("conv_id") % 2)).cast("string"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = i.table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), "turn", F.collect_list(name).over(so_far).alias("names"))
    return published.captured(rows).select("chain", "turn", F.array_join("new", ",").alias("new"), "problem")


@query(
    "SELECT user_id AS stream, event_id AS place, event_id * 2 AS n FROM events e WHERE event_type <> 'view' AND event_id % 10 <> 9 AND event_id < coalesce((SELECT min(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.event_id % 4 = 0), 1000000000)"
)
def event_stream(spark, d):
    """Events of line-framed streams up to each one's terminator; comments and blanks between them."""
    n = F.col("event_id")
    json = F.concat(F.lit('{"n": '), (n * 2).cast("string"), F.lit("}"))
    view = F.col("event_type") == "view"
    line = F.when(view & (n % 4 == 0), "data: [DONE]").when(view, ": keep alive").when(n % 10 == 9, "").when(n % 3 == 0, json).otherwise(F.concat(F.lit("data: "), json, F.lit("\r")))
    rows = i.table(spark, d, "events").select(F.col("user_id").alias("stream"), n.alias("place"), line.alias("value"))
    return published.events(rows, "n bigint", "stream", "place").where("bad IS NULL").select("stream", "place", "event.n")


# Vectors


@query(
    "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings v ON v.embedding IS NOT NULL)"
    " SELECT query_id, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"
)
def exact_topk(spark, d):
    """The twenty best by exact dot product for every hundredth vector, against all."""
    return exact(spark, d)


def exact(spark, d):
    e = i.table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.exact_top_k(e.select("vec_id", "embedding"), q, 20)


@query()
def score_recall(spark, d):
    """Of the twenty exact best of each query: the share that ``score_topk`` finds, and that the twenty best on codes alone hold."""
    e = i.table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    codes = vectors.encoded(e, "embedding", 64, 4).select("vec_id", "packed", "norm")
    near = vectors.top_k_each(codes, q, 64, 4, 60)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    alone = near.withColumn("rank", rank).where("rank <= 20").select("query_id", "vec_id", F.lit(1).alias("alone"))
    best = vectors.reranked(near, e, q, 20).select("query_id", "vec_id", F.lit(1).alias("found"))
    j = exact(spark, d).join(best, ["query_id", "vec_id"], "left").join(alone, ["query_id", "vec_id"], "left")
    share = lambda c: F.round(F.count(c) / F.count("*"), 4)
    return j.groupBy("query_id").agg(share("found").alias("recall"), share("alone").alias("recall_on_codes"))


@query()
def corrected_topk(spark, d):
    """The twenty best on 3-bit codes with the residuals' correction, for every hundredth vector."""
    e = i.table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    codes = vectors.encoded(vectors.with_residuals(e, "embedding", 64, 3).select("vec_id", "embedding", "signs", "residual_norm"), "embedding", 64, 3)
    return vectors.top_k_each(codes, q, 64, 3, 20, residuals=True).select("query_id", "vec_id", F.round("score", 4).alias("score"))


def states(spark, d):
    """Keys and values by layer and position: vectors, and the same reversed and scaled."""
    e = i.table(spark, d, "embeddings")
    return e.select(F.col("label").alias("layer"), "vec_id", F.col("embedding").alias("key"), F.transform(F.reverse("embedding"), lambda v: v * 3).cast("array<float>").alias("value"))


@query()
def tier_fidelity(spark, d):
    """What each tier keeps of keys and values, and what it takes."""
    return vectors.fidelity(states(spark, d), 64, [(3, 4, 64), (3, 2, 64), (4, 4, 64), (4, 4, 32)])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length, 64 AS d FROM embeddings")
def decoded_lengths(spark, d):
    """Length of each vector after coding and decoding: the norm is kept."""
    e = i.table(spark, d, "embeddings").select("vec_id", "embedding")
    v = vectors.decoded(vectors.encoded(e, "embedding", 64, 4), 64, 4)
    return v.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("vector"), F.col("vector"))), 5).alias("length"), F.size("vector").alias("d"))


@query("WITH g AS (SELECT vec_id, g, list_slice(embedding, g * 16 + 1, g * 16 + 16)::DOUBLE[] AS p FROM embeddings, unnest(range(0, 4)) u(g)) SELECT vec_id, g, round(list_min(p), 5) AS bias, round(greatest((list_max(p) - list_min(p)) / 15, 1e-12), 6) AS scale FROM g")
def group_scales(spark, d):
    """Scales and biases of four-bit groups of sixteen values."""
    e = i.table(spark, d, "embeddings").select("vec_id", vectors.group_quantised(F.col("embedding").cast("array<double>"), 4, 16).alias("c"))
    j = e.select("vec_id", F.posexplode(F.arrays_zip("c.bias", "c.scale")).alias("g", "z"))
    return j.select("vec_id", F.col("g").cast("long").alias("g"), F.round("z.bias", 5).alias("bias"), F.round("z.scale", 6).alias("scale"))


@query("SELECT n AS d, ceil(n / 16)::BIGINT AS two, ceil(n / 10)::BIGINT AS three, ceil(n / 8)::BIGINT AS four FROM (SELECT p_partkey AS n FROM part)")
def packing_widths(spark, d):
    n = F.col("p_partkey")
    return i.table(spark, d, "part").select(n.alias("d"), *[ch.block_width(n, b).alias(a) for b, a in ((2, "two"), (3, "three"), (4, "four"))])
