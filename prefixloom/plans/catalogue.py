"""The engine's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content, keys, tokens
from ..functions.tables import materialised
from ..operators import chunks as ch
from ..operators import evict, forensics, gates, lifecycle, policy, prefix, simulate, trace, vectors
from . import inputs as i
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

def routed(spark: SparkSession, d: str) -> DataFrame:
    return policy.classified(prefix.matches(i.requests(spark, d), i.entries(spark, d)))


ROUTE = ("request_id", "n_tokens", "entry", "matched_tokens", "on_path", "verdict", "prefill_from")


# Prefix matching and policy


@query(f"WITH {i.ROUTED} SELECT {', '.join(ROUTE)} FROM routed")
def lpm_route(spark, d):
    return routed(spark, d).select(*ROUTE)


@query(f"WITH {i.ROUTED} SELECT {', '.join(ROUTE)} FROM routed WHERE on_path")
def lpm_on_path(spark, d):
    return routed(spark, d).where("on_path").select(*ROUTE)


@query(f"WITH {i.ROUTED} SELECT {', '.join(ROUTE)} FROM routed WHERE NOT on_path")
def lpm_end_anchored(spark, d):
    return routed(spark, d).where("NOT on_path").select(*ROUTE)


@query(f"WITH {i.ROUTED} SELECT request_id, conv_id % 5 = 0 AS whole_context, entry, n_tokens = matched_tokens AS exact, verdict FROM routed")
def whole_context_fallback(spark, d):
    whole, exact = (F.col("conv_id") % 5 == 0).alias("whole_context"), (F.col("n_tokens") == F.col("matched_tokens")).alias("exact")
    return routed(spark, d).select("request_id", whole, "entry", exact, "verdict")


@query(f"WITH {i.ROUTED} SELECT conv_id % 2 AS engine_no, conv_id % 3 AS fp_no, count(*) AS n, count(entry) AS matched FROM routed GROUP BY ALL")
def domain_isolation(spark, d):
    return routed(spark, d).groupBy((F.col("conv_id") % 2).alias("engine_no"), (F.col("conv_id") % 3).alias("fp_no")).agg(F.count("*").alias("n"), F.count("entry").alias("matched"))


@query(f"WITH {i.ENTRIES}, key AS (SELECT tokens[1:1] AS key FROM entries ORDER BY name LIMIT 1) SELECT name, k::BIGINT AS n FROM entries, key WHERE tokens[1:1] = key OR k = 1")
def subtree_select(spark, d):
    e = i.entries(spark, d)
    key = e.orderBy("name").limit(1).select(F.slice("tokens", 1, 1)).first()[0]
    return prefix.subtree(e, key).select("name", F.size("tokens").cast("long").alias("n"))


@query(f"WITH {i.ENTRIES} SELECT name, EXISTS (SELECT 1 FROM entries b WHERE b.k > a.k AND b.tokens[1:a.k] = a.tokens) AS is_anchor FROM entries a")
def anchor_flags(spark, d):
    return prefix.with_anchor(i.entries(spark, d)).select("name", "is_anchor")


@query(
    f"WITH {i.ROUTED}, p AS (SELECT a.conv_id, a.turn, b.turn AS t, (SELECT count(*) FROM unnest(range(1, least(len(a.tokens), len(b.tokens)) + 1)) u(x) WHERE a.tokens[1:x] = b.tokens[1:x]) AS lcp"
    " FROM requests a JOIN requests b ON a.conv_id = b.conv_id AND b.turn < a.turn)"
    " SELECT r.conv_id, r.turn, coalesce(max(lcp), 0)::BIGINT AS declared_lcp FROM requests r LEFT JOIN p ON r.conv_id = p.conv_id AND r.turn = p.turn GROUP BY r.conv_id, r.turn"
)
def declared_lcp(spark, d):
    return prefix.declared_lcp(i.requests(spark, d), "conv_id", "turn")


@query(
    f"WITH {i.ROUTED}, passed AS (SELECT e.name, r.request_id FROM requests r JOIN entries e ON r.engine = e.engine AND r.fp = e.fp AND e.k >= 2 AND len(r.tokens) >= e.k AND r.tokens[1:e.k] = e.tokens"
    " AND (e.granularity = 0 OR e.k = len(r.tokens)) UNION ALL SELECT entry, request_id FROM routed WHERE NOT on_path) SELECT name, max(request_id) AS last_seq FROM passed GROUP BY name"
)
def touched_path(spark, d):
    return prefix.touched(i.requests(spark, d), i.entries(spark, d), "request_id")


_STATS = "count(*) AS requests, count(*) FILTER (WHERE verdict = 'hit') AS hits, count(*) FILTER (WHERE verdict = 'partial') AS partials, count(*) FILTER (WHERE verdict = 'miss') AS misses, sum(prefill_from)::BIGINT AS tokens_cached, sum(n_tokens)::BIGINT AS tokens_total, round(coalesce(sum(prefill_from) / nullif(sum(n_tokens), 0), 0), 4) AS hit_rate"


@query(f"WITH {i.ROUTED} SELECT {_STATS} FROM routed")
def stats_rollup(spark, d):
    return policy.stats(routed(spark, d))


@query(f"WITH {i.ROUTED} SELECT conv_id, {_STATS} FROM routed GROUP BY conv_id")
def hit_rate_by_conv(spark, d):
    return policy.stats(routed(spark, d), "conv_id")


@query(f"WITH {i.ROUTED} SELECT verdict, count(*) AS n FROM routed GROUP BY verdict")
def verdict_histogram(spark, d):
    return policy.histogram(routed(spark, d))


@query(
    f"WITH {i.ROUTED}, settled AS (SELECT n_tokens, CASE WHEN turn % 4 = 0 THEN 'miss' ELSE verdict END AS verdict, CASE WHEN turn % 4 = 0 THEN 0 ELSE prefill_from END AS prefill_from FROM routed) SELECT {_STATS} FROM settled"
)
def settled_stats(spark, d):
    return policy.stats(policy.settled(routed(spark, d), F.col("turn") % 4 == 0))


# Identity

_LANE = "list_reduce(list_prepend({seed}::UHUGEINT, list_transform(w, lambda x: x::UHUGEINT)), lambda h, x: (xor(h, x) * {prime}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_FNV = "lower(lpad(to_hex(" + _LANE.format(seed=0x9E3779B97F4A7C15, prime=0x880355F21E6D1965) + "), 16, '0') || lpad(to_hex(" + _LANE.format(seed=0xCBF29CE484222325, prime=0x100000001B3) + "), 16, '0'))"


@query(f"WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)::UBIGINT) AS w FROM documents) SELECT doc_id, {_FNV} AS prefix_hash FROM t")
def prefix_hash(spark, d):
    docs = i.table(spark, d, "documents")
    tokens = F.transform(F.split("text", " "), lambda x: F.length(x).cast("long"))
    with keys.wrapping(spark):
        return docs.select("doc_id", keys.prefix_hash(tokens).alias("prefix_hash"))


@query()
def blob_key(spark, d):
    docs = i.table(spark, d, "documents")
    fp = {"model_id": F.col("source"), "tokenizer_hash": F.lit("tok"), "kv_dtype": F.lit("f16"), "kv_layout_version": F.lit(1), "cache_layout": F.when(F.col("doc_id") % 2 == 0, "KV-KV").otherwise("")}
    tokens = F.transform(F.split("text", " "), lambda x: F.length(x).cast("long"))
    with keys.wrapping(spark):
        key = keys.blob_key(fp, F.when(F.col("doc_id") % 3 == 0, "llama-cpp"), tokens)
        return docs.select("doc_id", key.alias("blob_key"), keys.model_hash(key).alias("high"))


_PART = "'{\"image_url\":{\"detail\":' || turn || ',\"url\":\"u' || conv_id || '\"},\"type\":\"image_url\"}'"


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN sha256(length({_PART}) || ':' || {_PART}) ELSE '' END AS content_digest FROM conversations")
def content_digest(spark, d):
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    image = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("u"), "conv_id").alias("url"), F.col("turn").alias("detail")).alias("image_url"))
    parts = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("["), F.to_json(text), F.lit(","), F.to_json(image), F.lit("]"))).otherwise(F.concat(F.lit("["), F.to_json(text), F.lit("]")))
    messages = F.concat(F.lit('[{"role":"user","content":'), parts, F.lit("}]"))
    return i.table(spark, d, "conversations").select("conv_id", "turn", content.content_digest(messages).alias("content_digest"))


@query("SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda k: ('0x' || h[k * 8 + 7:k * 8 + 8] || h[k * 8 + 5:k * 8 + 6] || h[k * 8 + 3:k * 8 + 4] || h[k * 8 + 1:k * 8 + 2])::BIGINT % 2147483648), ',') AS tokens FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def synthetic_tokens(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.array_join(tokens.synthetic(F.col("text")), ",").alias("tokens"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def payload_digest(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("SELECT a.doc_id, count(*) AS same FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND sha256(a.text) = sha256(b.text) GROUP BY a.doc_id")
def identity_match(spark, d):
    x = i.table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))
    n = x.groupBy("lang", "source", "digest").agg(F.count("*").alias("same"))
    return x.join(n, ["lang", "source", "digest"]).select("doc_id", "same")


_TIERS = "concat('tq-k', p_partkey % 6, 'v', p_partkey % 9, '-g', p_partkey % 70)"


@query(
    f"SELECT p_partkey, CASE WHEN p_partkey % 6 IN (2, 3, 4) AND p_partkey % 9 IN (2, 3, 4, 6, 8) AND p_partkey % 70 >= 2 THEN p_partkey % 6 END::INT AS key_bits, CASE WHEN key_bits IS NOT NULL THEN p_partkey % 9 END::INT AS value_bits, CASE WHEN key_bits IS NOT NULL THEN p_partkey % 70 END::INT AS group_size FROM part"
)
def tier_parse(spark, d):
    t = i.table(spark, d, "part").withColumn("t", keys.tier(F.expr(_TIERS)))
    return t.select("p_partkey", "t.key_bits", "t.value_bits", "t.group_size")


# Lifecycle

_VERSIONS = "SELECT text AS key, doc_id AS generation, 'd' || lpad(doc_id::VARCHAR, 9, '0') AS name, doc_id % 3 + 1 AS format_version, source, lang FROM documents"


def versions(spark, d):
    name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return i.table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("generation"), name.alias("name"), (F.col("doc_id") % 3 + 1).alias("format_version"), "source", "lang")


@query(f"WITH v AS ({_VERSIONS}) SELECT name, row_number() OVER (PARTITION BY key ORDER BY generation DESC, name DESC) > 1 AS stale FROM v")
def keep_latest_generation(spark, d):
    return lifecycle.keep_latest(versions(spark, d), "key").select("name", "stale")


@query(f"WITH v AS ({_VERSIONS}) SELECT sha256(key) AS key, name, format_version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY format_version DESC, name DESC) AS rn FROM v) WHERE rn = 1")
def rank_dedupe(spark, d):
    return lifecycle.ranked(versions(spark, d), "key")


@query(f"WITH v AS ({_VERSIONS}) SELECT name, n AS superseded_by FROM (SELECT name, lead(name) OVER (PARTITION BY key ORDER BY name) AS n FROM v) WHERE n IS NOT NULL")
def stale_names(spark, d):
    return lifecycle.superseded_names(versions(spark, d), "key").select("name", "superseded_by")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 25)")
def orphan_manifests(spark, d):
    live = i.table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return lifecycle.orphans(i.table(spark, d, "orders").select("o_orderkey"), live, "o_orderkey")


@query(
    f"WITH {i.ENTRIES}, c AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'token_count' WHEN k < 2 THEN 'too_short' WHEN conv_id % 7 = 3 THEN 'digest' END AS reject FROM entries),"
    " s AS (SELECT CASE WHEN row_number() OVER (PARTITION BY engine, fp, tokens ORDER BY last_used DESC, name DESC) > 1 THEN 'stale' ELSE 'published' END AS state FROM c WHERE reject IS NULL UNION ALL SELECT reject FROM c WHERE reject IS NOT NULL)"
    " SELECT state, count(*) AS n FROM s GROUP BY state"
)
def rebuild_report(spark, d):
    e = i.entries(spark, d).withColumn("generation", F.col("last_used")).withColumn("token_count", F.size("tokens") + F.when(F.col("turn") % 5 == 4, 1).otherwise(0))
    return lifecycle.rebuild_report(e.withColumn("digest", F.lit("AB")).withColumn("payload_digest", F.when(F.col("conv_id") % 7 == 3, "cd").otherwise("ab")))


@query(f"WITH {i.ENTRIES}, q AS (SELECT name, row_number() OVER (ORDER BY last_used, name) AS rank, count(*) OVER () AS n FROM entries WHERE conv_id % 4 = 1) SELECT name, rank FROM q WHERE rank <= n - 5")
def quarantine_excess(spark, d):
    e = i.entries(spark, d).withColumn("state", F.when(F.col("conv_id") % 4 == 1, "quarantined").otherwise("published"))
    return lifecycle.quarantine_excess(e, 5).select("name", F.col("rank").cast("long"))


@query(f"WITH {i.ENTRIES}, key AS (SELECT tokens[1:1] AS key FROM entries ORDER BY name LIMIT 1) SELECT name FROM entries, key WHERE NOT (tokens[1:1] = key OR k = 1)")
def invalidate_prefix(spark, d):
    e = i.entries(spark, d)
    key = e.orderBy("name").limit(1).select(F.slice("tokens", 1, 1)).first()[0]
    return lifecycle.invalidate(e, key)[0].select("name")


# Eviction

_NOW, _WINDOW = 1000, 100
_ANCHORED = f"{i.ENTRIES}, flags AS (SELECT a.*, EXISTS (SELECT 1 FROM entries b WHERE b.k > a.k AND b.tokens[1:a.k] = a.tokens) AS is_anchor FROM entries a), cand AS (SELECT * FROM flags WHERE NOT is_anchor AND {_NOW} - last_used > {_WINDOW})"


def anchored(spark, d):
    return prefix.with_anchor(i.entries(spark, d))


@query(
    f"WITH {_ANCHORED}, t AS (SELECT sum(size_bytes) AS total FROM entries), s AS (SELECT name, size_bytes, coalesce(sum(size_bytes) OVER (ORDER BY k DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before FROM cand)"
    " SELECT name, size_bytes, freed_before FROM s, t WHERE total - freed_before > 400000"
)
def evict_whole_budget(spark, d):
    return evict.whole_budget(anchored(spark, d), 400_000, _NOW, _WINDOW)


@query(
    f"WITH {_ANCHORED}, {i.CHUNKS}, uses AS (SELECT DISTINCT blob AS name, digest, size FROM chunks WHERE turn % 2 = 0), h AS (SELECT digest, count(*) AS n, max(size) AS size FROM uses GROUP BY digest),"
    " u AS (SELECT c.name, coalesce(sum(CASE WHEN h.n = 1 THEN h.size END), 0)::BIGINT AS unique_bytes FROM cand c LEFT JOIN uses USING (name) LEFT JOIN h USING (digest) GROUP BY c.name),"
    " r AS (SELECT *, row_number() OVER (ORDER BY unique_bytes DESC, name) - 1 AS rank FROM u),"
    " dd AS (SELECT digest, max(rank) AS d, max(size) AS size FROM uses LEFT JOIN r USING (name) GROUP BY digest HAVING count(*) = count(rank)),"
    " f AS (SELECT r.name, r.unique_bytes, r.rank, coalesce((SELECT sum(size) FROM dd WHERE d < r.rank), 0)::BIGINT AS freed_before FROM r), t AS (SELECT sum(size) AS total FROM h)"
    " SELECT name, unique_bytes, rank, freed_before FROM f, t WHERE total - freed_before > 100000"
)
def evict_chunk_budget(spark, d):
    c = ch.fixed_blocks(i.payloads(spark, d), 256).where("turn % 2 = 0").select(F.col("blob").alias("name"), "digest", "size")
    return evict.chunk_budget(anchored(spark, d), c, 100_000, _NOW, _WINDOW)


@query(f"WITH {_ANCHORED}, s AS (SELECT name, row_number() OVER (ORDER BY k DESC, name) - 1 AS rank FROM cand) SELECT name, rank FROM s WHERE rank < (SELECT count(*) FROM entries) - 60")
def evict_entry_cap(spark, d):
    return evict.entry_cap(anchored(spark, d), 60, _NOW, _WINDOW)


@query(f"WITH {i.CHUNKS}, h AS (SELECT digest FROM chunks GROUP BY digest HAVING count(DISTINCT blob) = 1) SELECT blob, sum(size)::BIGINT AS unique_bytes FROM (SELECT DISTINCT blob, digest, size FROM chunks JOIN h USING (digest)) GROUP BY blob")
def unique_bytes(spark, d):
    c = ch.fixed_blocks(i.payloads(spark, d), 256)
    own = ch.refcounts(c).where("blobs = 1").select("digest")
    return c.select("blob", "digest", "size").distinct().join(own, "digest", "left_semi").groupBy("blob").agg(F.sum("size").cast("long").alias("unique_bytes"))


# Chunks


def blocks(spark, d):
    return ch.fixed_blocks(i.payloads(spark, d), 256)


@query(f"WITH {i.CHUNKS} SELECT blob, chunk_no, size, digest FROM chunks")
def fixed_block_chunks(spark, d):
    return blocks(spark, d).select("blob", F.col("chunk_no").cast("long").alias("chunk_no"), "size", "digest")


@query(f"WITH {i.CHUNKS} SELECT digest, count(*) AS refs, count(DISTINCT blob) AS blobs, max(size) AS size FROM chunks GROUP BY digest")
def refcounts(spark, d):
    return ch.refcounts(blocks(spark, d))


_RC = f"{i.CHUNKS}, rc AS (SELECT digest, count(*) AS refs, count(DISTINCT blob) AS blobs, max(size) AS size FROM chunks GROUP BY digest)"


@query(
    f"WITH {_RC} SELECT count(*) AS chunks_live, count(*) FILTER (WHERE blobs > 1) AS chunks_shared, coalesce(sum(size + 36) FILTER (WHERE blobs = 1), 0)::BIGINT AS unique_bytes, coalesce(sum(size + 36) FILTER (WHERE blobs > 1), 0)::BIGINT AS shared_bytes, sum(refs * size)::BIGINT AS logical_bytes, round(sum(refs * size) / sum(size + 36), 4) AS dedup_ratio FROM rc"
)
def share_store(spark, d):
    return ch.share_store(blocks(spark, d))


@query(
    f"WITH {_RC}, o AS (SELECT DISTINCT blob, digest FROM chunks) SELECT blob, coalesce(sum(size + 36) FILTER (WHERE blobs = 1), 0)::BIGINT AS unique_bytes, coalesce(sum(size + 36) FILTER (WHERE blobs > 1), 0)::BIGINT AS shared_bytes FROM o JOIN rc USING (digest) GROUP BY blob"
)
def share_blobs(spark, d):
    return ch.share_blobs(blocks(spark, d))


_NEW = f"{i.CHUNKS}, f AS (SELECT convo, digest, min(turn) AS first FROM chunks GROUP BY ALL), per AS (SELECT convo, turn, coalesce(sum(size) FILTER (WHERE turn = first), 0)::BIGINT AS new_bytes, sum(size)::BIGINT AS payload_bytes FROM chunks JOIN f USING (convo, digest) GROUP BY convo, turn)"


@query(f"WITH {_NEW} SELECT *, round(new_bytes / payload_bytes, 4) AS new_frac FROM per")
def new_bytes_per_turn(spark, d):
    return ch.new_bytes_per_turn(blocks(spark, d))


@query(
    f"WITH {_NEW}, t AS (SELECT convo, min(turn) AS t, count(*) AS turns FROM per GROUP BY convo) SELECT convo, max(turns) AS turns, round(sum(new_bytes) FILTER (WHERE turn > t) / sum(payload_bytes) FILTER (WHERE turn > t), 4) AS mean_new_frac, sum(new_bytes)::BIGINT AS unique_bytes FROM per JOIN t USING (convo) WHERE turns >= 2 GROUP BY convo"
)
def mean_new_frac(spark, d):
    return ch.mean_new_frac(ch.new_bytes_per_turn(blocks(spark, d)))


def segments(spark, d):
    c = blocks(spark, d)
    return i.records(c), c.where("turn % 2 = 0").select("digest").distinct()


@query(f"WITH {i.RECORDS} SELECT seg, total, dead, live_records FROM stats")
def segment_stats(spark, d):
    return ch.segment_stats(*segments(spark, d))


@query(f"WITH {i.RECORDS} SELECT sum(total)::BIGINT AS total, sum(dead)::BIGINT AS dead, count(*) FILTER (WHERE dead > 0 AND live_records > 0) AS partly_dead, count(*) FILTER (WHERE live_records = 0) AS empty_segments FROM stats")
def fragmentation(spark, d):
    return ch.fragmentation(ch.segment_stats(*segments(spark, d)))


@query(f"WITH {i.RECORDS} SELECT seg, total, dead, (total - dead + 8)::BIGINT AS new_bytes FROM stats WHERE seg <> 5 AND live_records > 0 AND dead > 0 AND dead >= 0.1 * total ORDER BY dead DESC, seg LIMIT 2")
def compaction_plan(spark, d):
    return ch.compaction_plan(ch.segment_stats(*segments(spark, d)), 5, 0.1, 1, 2)


@query(f"WITH {i.RECORDS} SELECT seg, digest, (coalesce(sum(body_len + 36) OVER (PARTITION BY seg ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8)::BIGINT AS new_off FROM placed WHERE here")
def packed_offsets(spark, d):
    return ch.packed_offsets(ch.placements(segments(spark, d)[0]).where("placed")).select("seg", "digest", "new_off")


_SPANS = "SELECT l_orderkey AS blob, l_partkey AS start, l_partkey + l_quantity::BIGINT AS \"end\" FROM lineitem"


def spans(spark, d):
    return i.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("blob"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))


@query(f'WITH s AS ({_SPANS}), g AS (SELECT blob, coalesce(lag("end") OVER (PARTITION BY blob ORDER BY start, "end"), 0)::BIGINT AS gap_start, start AS gap_end FROM s) SELECT * FROM g WHERE gap_end > gap_start')
def gap_chunks(spark, d):
    return ch.gaps(spans(spark, d))


@query(f'WITH s AS ({_SPANS}), g AS (SELECT *, lead(start) OVER (PARTITION BY blob ORDER BY start, "end") AS next_start FROM s) SELECT * FROM g WHERE next_start < "end"')
def overlap_check(spark, d):
    return ch.overlaps(spans(spark, d))


_CONTAIN = "a AS (SELECT convo AS pair, digest FROM chunks WHERE turn % 2 = 0), b AS (SELECT convo AS pair, digest FROM chunks WHERE turn % 2 = 1)"


@query(
    f"WITH {i.CHUNKS}, {_CONTAIN}, x AS (SELECT a.pair, round(count(b.digest) / count(*), 4) AS a_in_b FROM a LEFT JOIN (SELECT DISTINCT * FROM b) b USING (pair, digest) GROUP BY 1), y AS (SELECT b.pair, round(count(a.digest) / count(*), 4) AS b_in_a FROM (SELECT DISTINCT * FROM b) b LEFT JOIN (SELECT DISTINCT * FROM a) a USING (pair, digest) GROUP BY 1) SELECT pair, a_in_b, b_in_a FROM x JOIN y USING (pair)"
)
def block_containment(spark, d):
    c = blocks(spark, d).withColumn("pair", F.col("convo"))
    return ch.containment(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"))


@query()
def cdc_chunks(spark, d):
    return ch.content_defined(i.payloads(spark, d), 1024).select("blob", "chunk_no", "end_off", "size", "digest")


@query()
def boundary_stability(spark, d):
    return ch.stability(ch.content_defined(i.payloads(spark, d), 1024))


@query(f"WITH {i.CHUNKS} SELECT blob, sha256(payload) AS digest FROM pay")
def reassemble(spark, d):
    p = i.payloads(spark, d)
    block = F.substring(F.col("payload").cast("binary"), F.col("chunk_no") * 256 + 1, F.lit(256))
    at = F.sequence(F.lit(0), F.floor((F.octet_length("payload") - 1) / 256).cast("int"))
    cut = p.withColumn("chunk_no", F.explode(at)).select("blob", "chunk_no", block.alias("body")).withColumn("digest", F.sha2("body", 256))
    return ch.reassembled(cut.drop("body"), cut.select("digest", "body")).select("blob", F.sha2("payload", 256).alias("digest"))


@query(
    "WITH h AS (SELECT doc_id, hex(text) AS x FROM documents), z AS (SELECT a.doc_id, least(length(a.x), length(b.x)) AS n, list_position(list_transform(list_zip(string_split(a.x, ''), string_split(b.x, '')), lambda p: p[1] IS DISTINCT FROM p[2]), true) AS spot FROM h a JOIN h b ON b.doc_id = a.doc_id + 1)"
    " SELECT doc_id, CASE WHEN spot <= n THEN (spot - 1) // 2 END::BIGINT AS first_diff_byte FROM z"
)
def byte_divergence(spark, d):
    t = i.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("a"))
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return t.join(after, "doc_id").select("doc_id", forensics.first_diff("a", "b").alias("first_diff_byte"))


@query(
    "WITH pay AS (SELECT conv_id AS convo, turn, 'c' || conv_id || '-t' || turn AS blob, string_agg(hex(text), '') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),"
    " j AS (SELECT a.blob AS pair, a.p, b.p AS q, length(a.p) // 2 AS wa, length(b.p) // 2 AS wb, h FROM pay a JOIN pay b ON b.convo = a.convo AND b.turn = a.turn + 1, unnest([0, 1]) u(h))"
    " SELECT pair, 'kv' AS tensor, count(*) AS n_heads, count(*) FILTER (WHERE substring(p, h * wa + 1, least(wa, wb)) = substring(q, h * wb + 1, least(wa, wb))) AS heads_equal FROM j GROUP BY pair"
)
def heads_exact(spark, d):
    """Turn against next turn, as two heads of a tensor; one byte a position."""
    p = i.payloads(spark, d)
    a = p.select("convo", "turn", F.col("blob").alias("pair"), F.lit("kv").alias("tensor"), F.col("payload").alias("a"), F.lit(2).alias("n_heads"))
    pairs = a.join(p.select("convo", (F.col("turn") - 1).alias("turn"), F.col("payload").alias("b")), ["convo", "turn"])
    return forensics.heads_exact(forensics.heads_compared(pairs, F.floor(F.length("a") / 2)))


@query()
def segment_rolling(spark, d):
    return forensics.rolled(ch.content_defined(i.payloads(spark, d), 1024), 8192)


@query(f"WITH {i.CHUNKS} SELECT blob, chunk_no, least(coalesce(sum(size) OVER (PARTITION BY blob ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 // sum(size) OVER (PARTITION BY blob), 3)::BIGINT AS worker FROM chunks")
def worker_groups(spark, d):
    return forensics.worker_groups(blocks(spark, d), 4, "blob", "chunk_no").select("blob", F.col("chunk_no").cast("long").alias("chunk_no"), "worker")


# Traces

_EVENTS = "events"


@query("SELECT event_type, s[least(len(s) - 1, floor(len(s) * 0.5)::INT) + 1] AS p50, s[least(len(s) - 1, floor(len(s) * 0.95)::INT) + 1] AS p95, len(s)::BIGINT AS n FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)")
def pct_index(spark, d):
    return trace.pct_index(i.table(spark, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, s[round_even(0.5 * (len(s) - 1), 0)::INT + 1] AS p50, s[round_even(0.95 * (len(s) - 1), 0)::INT + 1] AS p95, len(s)::BIGINT AS n FROM (SELECT user_id, list_sort(list(value)) AS s FROM events GROUP BY user_id)")
def pct_round(spark, d):
    return trace.pct_round(i.table(spark, d, "events"), "value", ["user_id"], {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, round(s[1], 4) AS min_s, round(s[len(s) // 2 + 1], 4) AS median_s, round(s[least(len(s) - 1, floor(len(s) * 0.9)::INT) + 1], 4) AS p90_s, len(s)::BIGINT AS n FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)")
def restore_stats(spark, d):
    return trace.restore_stats(i.table(spark, d, "events"), "value", ["event_type"])


@query("SELECT event_id, round((value * 10 - value) / greatest(event_id % 9 - 1, 1), 4) AS tpot_ms FROM events WHERE event_id % 9 >= 2")
def tpot(spark, d):
    e = i.table(spark, d, "events").where("event_id % 9 >= 2")
    return e.select("event_id", F.round(trace.tpot(F.col("value") * 10, F.col("value"), F.col("event_id") % 9), 4).alias("tpot_ms"))


_SAMPLES = f"{i.ROUTED}, samples AS (SELECT conv_id, turn, turn % 3 AS leg, n_tokens AS prompt_tokens, matched_tokens AS declared_lcp, prefill_from AS served, CASE WHEN conv_id % 6 <> 0 THEN verdict END AS verdict FROM routed)"


def samples(spark, d):
    r = routed(spark, d)
    return r.select("conv_id", "turn", (F.col("turn") % 3).alias("leg"), F.col("n_tokens").alias("prompt_tokens"), F.col("matched_tokens").alias("declared_lcp"), F.col("prefill_from").alias("served"), F.when(F.col("conv_id") % 6 != 0, F.col("verdict")).alias("verdict"))


@query(
    f"WITH {_SAMPLES} SELECT leg, count(*) AS n, count(verdict) AS n_instrumented, sum(prompt_tokens)::BIGINT AS prompt_tokens, round(100 * sum(served) FILTER (WHERE verdict IS NOT NULL) / nullif(sum(prompt_tokens) FILTER (WHERE verdict IS NOT NULL), 0), 2) AS served_pct, round(100 * sum(declared_lcp) FILTER (WHERE verdict IS NOT NULL) / nullif(sum(prompt_tokens) FILTER (WHERE verdict IS NOT NULL), 0), 2) AS reuse_pct FROM samples GROUP BY leg"
)
def leg_summary(spark, d):
    return trace.leg_summary(samples(spark, d), "leg")


@query(f"WITH {_SAMPLES} SELECT conv_id, turn, unnest(list_filter(['lcp_over_prompt', CASE WHEN served > declared_lcp - 3 THEN 'served_over_lcp' END][2:], lambda x: x IS NOT NULL)) AS problem FROM samples")
def premise_violations(spark, d):
    s = samples(spark, d).withColumn("declared_lcp", F.col("declared_lcp") - 3)
    return trace.premise_violations(s).select("conv_id", "turn", "problem")


@query(
    "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'click'), n AS (SELECT user_id, (SELECT count(*) FROM a WHERE a.user_id = x.user_id) = (SELECT count(*) FROM b WHERE b.user_id = x.user_id) AS matched FROM (SELECT DISTINCT user_id FROM events) x) SELECT a.user_id, a.event_id AS sample, b.event_id AS record, matched FROM a JOIN b USING (user_id, k) JOIN n USING (user_id)"
)
def positional_join(spark, d):
    e = i.table(spark, d, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("sample"))
    return trace.positional_join(a, e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("record")), "user_id", "sample", "record")


@query("SELECT user_id, round(max_by(value, event_id) - min_by(value, event_id), 6) AS delta FROM events GROUP BY user_id")
def counter_delta(spark, d):
    return trace.counter_delta(i.table(spark, d, "events"), "user_id", "event_id", "value").withColumn("delta", F.round("delta", 6))


@query(
    "WITH r AS (SELECT l_orderkey, l_partkey AS s, l_partkey + l_quantity::BIGINT * 20 AS e, l_suppkey AS k, l_linenumber FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM r), f AS (SELECT *, sum(CASE WHEN ahead IS NULL OR s > ahead THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS flight FROM o) SELECT k, flight::BIGINT AS flight, count(*) AS n, min(s) AS first_start, max(e) AS last_end FROM f GROUP BY k, flight"
)
def single_flight_groups(spark, d):
    r = i.table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long") * 20).alias("e"), F.col("l_suppkey").alias("k"))
    return trace.single_flight(r, "k", "s", "e").groupBy("k", "flight").agg(F.count("*").alias("n"), F.min("s").alias("first_start"), F.max("e").alias("last_end"))


@query(
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), z AS (SELECT a.doc_id, greatest(len(a.w), len(b.w)) AS n, list_transform(list_zip(a.w, b.w), lambda p: coalesce(p[1] = p[2], false)) AS same FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)"
    " SELECT doc_id, round(len(list_filter(same, lambda s: s)) / n, 6) AS agreement, (list_position(same, false) - 1)::BIGINT AS first_divergence FROM z"
)
def greedy_agreement(spark, d):
    w = i.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("a"))
    g = gates.agreement(w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id"), "a", "b")
    return g.select("doc_id", F.round("agreement", 6).alias("agreement"), F.col("first_divergence").cast("long").alias("first_divergence"))


@query(
    "WITH s AS (SELECT CASE WHEN len(string_split(text, ' ')) < 2 THEN 'too_short' WHEN doc_id % 11 = 0 THEN 'identity_unavailable' WHEN len(string_split(text, ' ')) > 500 THEN 'token_cap'"
    " WHEN doc_id % 7 = 0 THEN 'empty_payload' WHEN n_chars > 2000 THEN 'size_cap' ELSE 'settled' END AS reason FROM documents) SELECT reason, count(*) AS n FROM s GROUP BY reason"
)
def settle_refusals(spark, d):
    docs = i.table(spark, d, "documents").select(
        F.split("text", " ").alias("tokens"), F.when(F.col("doc_id") % 11 == 0, "missing").otherwise("tok").alias("tokenizer_hash"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars")).alias("payload_bytes")
    )
    return docs.groupBy(F.coalesce(gates.settle_refusal(500, 2000), F.lit("settled")).alias("reason")).agg(F.count("*").alias("n"))


# Vectors


@query("SELECT vec_id, array_to_string(list_transform(range(0, 4), lambda g: list_sum(list_transform(range(0, 16), lambda k: (CASE WHEN embedding[g * 16 + k + 1] > 0 THEN 3 ELSE 1 END) * (1::BIGINT << (2 * k)))))::VARCHAR[], ',') AS packed FROM embeddings")
def pack_bits(spark, d):
    idx = F.transform("embedding", lambda v: F.when(v > 0, 3).otherwise(1))
    return i.table(spark, d, "embeddings").select("vec_id", F.array_join(vectors.packed_words(idx, 2), ",").alias("packed"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def cosine_fidelity(spark, d):
    e = i.table(spark, d, "embeddings")
    q = e.withColumn("q", e.where("vec_id = 0").select("embedding").scalar())
    return q.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 4).alias("cosine"))


@query()
def codebook_encode(spark, d):
    return vectors.encoded(i.table(spark, d, "embeddings"), "embedding", 64, 3).select("vec_id", F.array_join("packed", ",").alias("packed"), F.round("norm", 4).alias("norm"))


@query()
def score_topk(spark, d):
    """The twenty best for every hundredth vector: sixty on 4-bit codes of all vectors, then by exact dot product (``score_recall`` measures it)."""
    e = i.table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vectors.top_k_each(vectors.encoded(e, "embedding", 64, 4).select("vec_id", "packed", "norm"), q, 64, 4, 60)
    return vectors.reranked(near, e, q, 20).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query()
def score_corrected(spark, d):
    """Scores against vector 0 with the residuals' correction."""
    e = i.table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    codes = vectors.encoded(vectors.with_residuals(e, "embedding", 64, 3).select("vec_id", "embedding", "signs", "residual_norm"), "embedding", 64, 3)
    return vectors.corrected(vectors.scored(codes, q, 3), q).select("vec_id", F.round("score", 4).alias("score"))


# Events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return i.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, count(*) AS n FROM events, unnest([0, 1]) u(k) GROUP BY ALL")
def sliding_counts(spark, d):
    return i.table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")


@query(
    "WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g"
)
def session_gaps(spark, d):
    return i.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")


# Simulation


def chains(spark, d):
    c = ch.block_lists(i.payloads(spark, d).select("convo", "turn", "payload"), 256)
    return simulate.listed(i.turns(spark, d).select(F.col("conv_id").alias("convo"), "turn", F.size("tokens").alias("tokens")), c)


_SIM = ("trace", "name", "store", "hit_rate", "reused_positions", "requested_positions", "final_bytes", "peak_bytes", "evictions", "over_budget", "budget_bytes", "binding", "window_ticks", "restore_bytes")
_STEPS = f"""{i.TURNS}, {i.CHUNKS}, blobs AS (SELECT convo, turn, sum(size)::BIGINT AS size FROM chunks GROUP BY ALL),
firsts AS (SELECT convo, digest, min(turn) AS turn, max(size) AS size FROM chunks GROUP BY ALL), fresh AS (SELECT convo, turn, sum(size)::BIGINT AS fresh FROM firsts GROUP BY ALL),
e AS (SELECT b.convo, b.turn, len(t.tokens) AS tokens, b.size, coalesce(f.fresh, 0) AS fresh, lag(len(t.tokens)) OVER w AS before, sum(b.size) OVER w AS whole, sum(coalesce(f.fresh, 0)) OVER w AS chunked
  FROM blobs b JOIN turns t ON t.conv_id = b.convo AND t.turn = b.turn LEFT JOIN fresh f ON f.convo = b.convo AND f.turn = b.turn WINDOW w AS (PARTITION BY b.convo ORDER BY b.turn))"""


@query()
def replay_grid(spark, d):
    entries, rows = simulate.grid(chains(spark, d), [0, 50_000, 200_000], [0, 20])
    return simulate.replay(entries, rows, lanes=12).select(*_SIM)


def experiment(spark, d):
    own = materialised(chains(spark, d))  # three plans read them
    entries, rows = simulate.scenarios(own.withColumn("trace", F.col("convo").cast("string")), [0.5, 1, 2])
    return simulate.replay(entries, rows)


@query()
def sim_scenarios(spark, d):
    """Both conversations of every chain under all scenarios."""
    return experiment(spark, d).select(*_SIM)


@query(
    f"WITH {_STEPS}, s AS (SELECT convo::VARCHAR AS trace, round(sum(coalesce(before - 1, 0)) / sum(tokens - 1), 4) AS hit_rate, sum(coalesce(before - 1, 0))::BIGINT AS reused_positions, sum(tokens - 1)::BIGINT AS requested_positions, sum(size)::BIGINT AS w, sum(fresh)::BIGINT AS c FROM e GROUP BY convo)"
    " SELECT trace, u.store, hit_rate, reused_positions, requested_positions, CASE WHEN u.store = 'whole' THEN w ELSE c END AS final_bytes FROM s, unnest(['whole', 'chunk']) u(store)"
)
def sim_growth(spark, d):
    """Chains without a budget."""
    return experiment(spark, d).where("name = 'S1 growth'").select("trace", "store", "hit_rate", "reused_positions", "requested_positions", "final_bytes")


@query(f"WITH {_STEPS} SELECT convo::VARCHAR AS trace, u.store, row_number() OVER (PARTITION BY convo, u.store ORDER BY turn) - 1 AS tick, CASE WHEN u.store = 'whole' THEN whole ELSE chunked END::BIGINT AS bytes FROM e, unnest(['whole', 'chunk']) u(store)")
def sim_trajectory(spark, d):
    """Bytes of the store after each request of a chain without a budget."""
    out = experiment(spark, d).where("name = 'S1 growth'")
    return out.select("trace", "store", F.posexplode("trajectory").alias("tick", "bytes")).withColumn("tick", F.col("tick").cast("long"))


@query(
    f"WITH {_STEPS}, g AS (SELECT convo, turn, size, tokens, row_number() OVER w AS i, greatest(size - lag(size) OVER w, 0) AS own FROM e WINDOW w AS (PARTITION BY convo ORDER BY turn)),"
    " f AS (SELECT c.convo, sum(c.size) AS base, count(*) AS n FROM (SELECT DISTINCT convo, turn, digest, size FROM chunks) c JOIN g ON g.convo = c.convo AND g.turn = c.turn AND g.i = 1 GROUP BY c.convo)"
    " SELECT g.convo || '+b' AS convo, turn, tokens::BIGINT AS tokens, (f.n + count(CASE WHEN own > 0 THEN 1 END) OVER w)::BIGINT AS chunks, (f.base + sum(coalesce(own, 0)) OVER w)::BIGINT AS bytes FROM g JOIN f ON f.convo = g.convo WINDOW w AS (PARTITION BY g.convo ORDER BY turn) QUALIFY i > 1"
)
def sim_second_conversation(spark, d):
    b = simulate.second_conversation(chains(spark, d).withColumn("trace", F.col("convo").cast("string")).withColumn("convo", F.col("convo").cast("string")))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("convo", "turn", "tokens", F.size("digests").cast("long").alias("chunks"), total.alias("bytes"))


@query()
def sim_store_ratios(spark, d):
    """The chunk store's hit rate beside the whole-blob store's."""
    return simulate.ratios(experiment(spark, d))


# Relations


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def pricing_rollup(spark, d):
    li = i.table(spark, d, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, d):
    o, c, n = (i.table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def customers_with_orders(spark, d):
    c = i.table(spark, d, "customer")
    have = c.join(i.table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")
    return have.subtract(c.where("c_acctbal < 0").select("c_custkey"))


@query("SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 2")
def top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return i.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rk")).where("rk <= 2")


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::BIGINT AS all_status, grouping(o_orderpriority)::BIGINT AS all_priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(spark, d):
    g = lambda c: F.grouping(c).cast("long")
    return i.table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(g("o_orderstatus").alias("all_status"), g("o_orderpriority").alias("all_priority"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def nations_both(spark, d):
    return i.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(i.table(spark, d, "customer").select("c_nationkey"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders")
def running_spend(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gap = F.col("o_orderkey") - F.lag("o_orderkey").over(w)
    return i.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"), gap.alias("gap"))


from . import identities, storage, studies  # noqa: E402, F401  (their queries join the same registry)
