"""Queries over identities, names and the life of entries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import identity, lifecycle, policy, prefix
from . import inputs as i
from .registry import ORACLE_SQL, query


def prints(spark, d):
    """doc_id, fp: fingerprints that differ in one field or none."""
    docs = i.table(spark, d, "documents")
    k = F.col("doc_id") % 6
    fp = identity.fingerprint(
        model_id=F.col("source"), tokenizer_hash=F.when(k == 1, "other").otherwise("tok"), kv_dtype=F.lit("f16"), kv_layout_version=F.when(k == 2, 2).otherwise(1), kv_bits=F.when(k == 3, 8),
        cache_layout=F.when(k == 4, "KV-KV"), content_digest=F.when(k == 5, F.sha2("lang", 256)), kv_tier=F.lit(None),
    )
    return docs.select("doc_id", "source", "lang", fp.alias("fp"))


_PRINTS = """p AS (SELECT doc_id, source AS model_id, CASE WHEN doc_id % 6 = 1 THEN 'other' ELSE 'tok' END AS tok, CASE WHEN doc_id % 6 = 2 THEN 2 ELSE 1 END AS version, CASE WHEN doc_id % 6 = 3 THEN 8 ELSE 0 END AS bits,
CASE WHEN doc_id % 6 = 4 THEN 'KV-KV' ELSE '' END AS layout, CASE WHEN doc_id % 6 = 5 THEN sha256(lang) ELSE '' END AS digest FROM documents)"""


@query(f"WITH {_PRINTS} SELECT a.doc_id, count(*) AS fits FROM p a JOIN p b USING (model_id, tok, version, bits, layout, digest) GROUP BY a.doc_id")
def identity_groups(spark, d):
    """How many documents' fingerprints are equal, joined on the nine fields as one key."""
    p = prints(spark, d)
    n = p.groupBy("fp").agg(F.count("*").alias("fits"))
    return p.join(n, "fp").select("doc_id", "fits")


@query(
    f"WITH {_PRINTS} SELECT a.doc_id, array_to_string(list_filter([CASE WHEN a.model_id <> b.model_id THEN 'model_id' END, CASE WHEN a.tok <> b.tok THEN 'tokenizer_hash' END, CASE WHEN a.version <> b.version THEN 'kv_layout_version' END,"
    " CASE WHEN a.bits <> b.bits THEN 'kv_bits' END, CASE WHEN a.layout <> b.layout THEN 'cache_layout' END, CASE WHEN a.digest <> b.digest THEN 'content_digest' END], lambda x: x IS NOT NULL), ',') AS differs,"
    " a.model_id = b.model_id AND a.tok = b.tok AND a.version = b.version AND a.bits = b.bits AND a.layout = b.layout AND a.digest = b.digest AS fits, a.layout = b.layout AS layout_fits, a.digest = b.digest AS digest_fits FROM p a JOIN p b ON b.doc_id = a.doc_id + 6 + a.doc_id % 2"
)
def identity_fields(spark, d):
    p = prints(spark, d)
    b = p.select(F.col("doc_id").alias("other"), F.col("fp").alias("b"))
    j = p.join(b, F.col("other") == F.col("doc_id") + 6 + F.col("doc_id") % 2)
    fp, o = F.col("fp"), F.col("b")
    return j.select(
        "doc_id", F.array_join(identity.differing(fp, o), ",").alias("differs"), identity.compatible(fp, o).alias("fits"),
        identity.layout_compatible(fp["cache_layout"], o["cache_layout"]).alias("layout_fits"), identity.digest_compatible(fp["content_digest"], o["content_digest"]).alias("digest_fits"),
    )


@query(
    f"WITH {i.ROUTED}, l AS (SELECT r.request_id, e.name, e.k, r.tokens[e.k] = e.tokens[e.k] AS on_path, e.last_used, e.tokens[e.k] AS t FROM requests r JOIN entries e ON r.engine = e.engine AND e.k >= 2 AND len(r.tokens) >= e.k AND r.tokens[1:e.k - 1] = e.tokens[1:e.k - 1]"
    " WHERE CASE WHEN e.granularity = 1 THEN r.tokens[e.k] = e.tokens[e.k] AND e.k = len(r.tokens) ELSE true END), w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY k DESC, on_path DESC, last_used DESC, t, name) = 1)"
    " SELECT r.request_id, w.name AS entry, coalesce(w.k, 0)::BIGINT AS matched_tokens FROM requests r LEFT JOIN w USING (request_id)"
)
def lpm_without_fingerprints(spark, d):
    """Matches within an engine, whatever the fingerprint."""
    return prefix.matches(i.requests(spark, d), i.entries(spark, d), fingerprint_gate=False).select("request_id", "entry", "matched_tokens")


def _arbitrated(side: str) -> str:
    where = "entries WHERE turn % 4 = 0" if side == "m" else "entries WHERE turn % 4 <> 0"
    return (
        f"{side}p AS (SELECT r.request_id, e.name, e.k, r.tokens[e.k] = e.tokens[e.k] AS on_path, e.last_used, e.tokens[e.k] AS t, e.granularity, len(r.tokens) AS n FROM requests r JOIN (SELECT * FROM {where}) e ON r.engine = e.engine AND r.fp = e.fp AND e.k >= 2"
        f" AND len(r.tokens) >= e.k AND r.tokens[1:e.k - 1] = e.tokens[1:e.k - 1]), {side} AS (SELECT * FROM {side}p WHERE CASE WHEN granularity = 1 THEN on_path AND k = n ELSE true END QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY k DESC, on_path DESC, last_used DESC, t, name) = 1)"
    )


@query(
    f"WITH {i.ROUTED}, {_arbitrated('m')}, {_arbitrated('d')} SELECT r.request_id, CASE WHEN coalesce(d.k, 0) >= 2 AND d.k - 1 > coalesce(m.k - 1, 0) THEN 'disk' WHEN coalesce(m.k, 0) >= 2 THEN 'memory' END AS source,"
    " CASE WHEN source = 'disk' THEN d.name WHEN source = 'memory' THEN m.name END AS entry, (CASE WHEN source = 'disk' THEN d.k - 1 WHEN source = 'memory' THEN m.k - 1 ELSE 0 END)::BIGINT AS covered FROM requests r LEFT JOIN m USING (request_id) LEFT JOIN d USING (request_id)"
)
def memory_or_disk(spark, d):
    e = i.entries(spark, d)
    return prefix.arbitrated(i.requests(spark, d), e.where("turn % 4 = 0"), e.where("turn % 4 <> 0")).select("request_id", "source", "entry", "covered")


@query(f"WITH {i.ROUTED} SELECT DISTINCT e.name FROM entries e JOIN requests r ON e.tokens = r.tokens")
def exact_keys(spark, d):
    return prefix.exact(i.entries(spark, d), i.requests(spark, d)).select("name")


# Refusals


@query(
    "WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: CASE WHEN doc_id % 9 = 4 THEN -1 ELSE length(x) END) AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 2 THEN 'prefix_under_two' WHEN doc_id % 9 = 4 THEN 'invalid_tokens' WHEN doc_id % 9 = 5 THEN 'invalid_engine'"
    " WHEN doc_id % 9 = 6 THEN 'invalid_granularity' WHEN doc_id % 9 = 7 THEN 'unresolved_identity' END AS refused FROM t"
)
def publish_refusals(spark, d):
    k = F.col("doc_id") % 9
    tokens = F.transform(F.split("text", " "), lambda x: F.when(k == 4, -1).otherwise(F.length(x)).cast("long"))
    fp = identity.fingerprint(model_id=F.lit("m"), tokenizer_hash=F.when(k == 7, "missing").otherwise("tok"), kv_dtype=F.lit("f16"), kv_layout_version=F.lit(1))
    why = identity.publish_refusal(F.col("tokens"), F.col("engine"), F.col("g"), F.col("fp"))
    rows = i.table(spark, d, "documents").select("doc_id", tokens.alias("tokens"), F.when(k != 5, "e").alias("engine"), F.when(k == 6, 2).otherwise(0).alias("g"), fp.alias("fp"))
    return rows.select("doc_id", why.alias("refused"))


@query(
    "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_model' WHEN coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id END, 64) > 8192 THEN 'max_tokens' END AS refused, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id END, 64) AS max_tokens,"
    " CASE WHEN event_id % 5 >= coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id END, 64) AND event_id % 3 <> 0 AND event_id > 0 THEN 'length' ELSE 'stop' END AS finish, CASE event_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'transport' ELSE 'upstream' END AS error FROM events"
)
def request_checks(spark, d):
    e = i.table(spark, d, "events")
    asked = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    status = F.element_at(F.array(*[F.lit(x) for x in (422, 503, 500, 404)]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        "event_id", identity.request_refusal(F.col("event_type"), ["click", "view"], asked).alias("refused"), identity.most_tokens(asked).alias("max_tokens"),
        policy.finish_reason(identity.most_tokens(asked), F.col("event_id") % 5).alias("finish"), policy.error_class(status).alias("error"),
    )


_REFS = "CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id || '.ckpt' WHEN 1 THEN '../x' WHEN 2 THEN '' WHEN 3 THEN 'a' || chr(92) || 'b' ELSE '..' END"


@query(f"SELECT doc_id, doc_id % 5 = 0 AS bare, CASE WHEN doc_id % 4 = 0 THEN lang || doc_id % 3 ELSE 'unspecified' END AS reason FROM (SELECT doc_id, lang, {_REFS} AS ref FROM documents)")
def reference_checks(spark, d):
    n = F.col("doc_id").cast("string")
    ref = F.element_at(F.array(F.concat(F.lit("a"), n, F.lit(".ckpt")), F.lit("../x"), F.lit(""), F.lit("a\\b"), F.lit("..")), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("lang", (F.col("doc_id") % 3).cast("string"), F.lit(": more words"))).otherwise("No Code: here")
    return i.table(spark, d, "documents").select("doc_id", identity.bare(ref).alias("bare"), policy.settle_reason(text).alias("reason"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 7 = 1 THEN 'unresolved' ELSE 'm' || c_nationkey || '|' || CASE WHEN c_custkey % 7 = 2 THEN 'a' ELSE '' END || '|' || CASE WHEN c_custkey % 7 = 3 THEN 'd' ELSE '' END END AS model FROM customer")
def model_names(spark, d):
    k = F.col("c_custkey") % 7
    model = F.when(k == 0, "").otherwise(F.concat(F.lit("m"), F.col("c_nationkey").cast("string")))
    return i.table(spark, d, "customer").select("c_custkey", identity.model_name(model, F.when(k == 1, "").when(k == 2, "a"), F.when(k == 3, "d")).alias("model"))


# Names and generations

_NAMES = "SELECT o_orderkey, sha256(o_custkey::VARCHAR)[1:32] AS key, ((epoch_ms(o_orderdate) << 16) | (o_orderkey % 70000 & 65535))::BIGINT AS generation, key || '-' || lower(lpad(to_hex(generation), 16, '0')) || '.ckpt' AS name FROM orders"


def names(spark, d):
    o = i.table(spark, d, "orders")
    key = F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, 32)
    made = identity.generation(identity.utc_ms(F.col("o_orderdate")), F.col("o_orderkey") % 70000)
    o = o.select("o_orderkey", "o_custkey", key.alias("key"), made.alias("generation"))
    return o.withColumn("name", identity.blob_name(F.col("key"), F.col("generation")))


@query(f"SELECT o_orderkey, key, generation, name, generation::DECIMAL(20, 0) AS parsed, name[1:16] AS short FROM ({_NAMES})")
def blob_names(spark, d):
    return names(spark, d).select("o_orderkey", "key", "generation", "name", lifecycle.generation_of(F.col("name")).alias("parsed"), identity.short_digest(F.col("name")).alias("short"))


@query(f"SELECT max(generation)::DECIMAL(20, 0) AS generation FROM ({_NAMES})")
def last_generation(spark, d):
    return lifecycle.last_generation(names(spark, d).select("name").unionByName(spark.createDataFrame([("notes.txt",)], "name string")))


@query(f"SELECT c_custkey, ((SELECT max(generation) FROM ({_NAMES})) + row_number() OVER (ORDER BY c_custkey))::DECIMAL(20, 0) AS generation FROM customer")
def reserved_generations(spark, d):
    return lifecycle.reserved(i.table(spark, d, "customer").select("c_custkey"), names(spark, d), "c_custkey")


# Stores

_OPEN = f"""n AS ({_NAMES}), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 3 THEN 'x' || name ELSE name END AS name, key, CASE WHEN o_orderkey % 13 = 5 THEN 'digest' END AS reject, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS v FROM n),
f AS (SELECT *, CASE WHEN reject IS NOT NULL OR (v > 1 AND o_orderkey % 11 = 3) THEN 'corrupt' WHEN v = 1 THEN 'legacy' ELSE 'indexed' END AS first FROM s)"""


@query(f"WITH {_OPEN} SELECT name, CASE WHEN first = 'indexed' AND row_number() OVER (PARTITION BY key, first ORDER BY v DESC, name DESC) > 1 THEN 'superseded' ELSE first END AS state FROM f")
def store_open(spark, d):
    n, k = names(spark, d), F.col("o_orderkey")
    version = F.when(k % 7 == 0, 1).otherwise(2)
    blobs = n.select(
        F.when(k % 11 == 3, F.concat(F.lit("x"), "name")).otherwise(F.col("name")).alias("name"), "key", F.when(k % 13 == 5, "digest").alias("reject"), version.alias("format_version"),
        F.when(version > 1, "ab").alias("payload_sha256"),
    )
    return lifecycle.opened(blobs).select("name", "state")


@query(f"WITH n AS ({_NAMES}) SELECT name, n AS superseded_by FROM (SELECT name, lead(name) OVER (PARTITION BY key ORDER BY name) AS n FROM n) WHERE n IS NOT NULL")
def put_supersedes(spark, d):
    n = names(spark, d).select("key", "name", "o_orderkey")
    return lifecycle.put(n.where("o_orderkey % 2 = 0"), n.where("o_orderkey % 2 = 1"), "key")[1]


@query(f"WITH n AS ({_NAMES}) SELECT key, max(name) AS name FROM n GROUP BY key")
def put_keeps(spark, d):
    n = names(spark, d).select("key", "name", "o_orderkey")
    return lifecycle.put(n.where("o_orderkey % 2 = 0"), n.where("o_orderkey % 2 = 1"), "key")[0].select("key", "name")


def states(spark, d):
    e = i.entries(spark, d).withColumn("generation", F.col("turn") + 1)
    return e.withColumn("state", F.when(F.col("conv_id") % 4 == 1, "quarantined").otherwise("published"))


def targets(spark, d):
    """Every third conversation's entries, half of them by an old generation."""
    return states(spark, d).where("conv_id % 3 = 0").select("name", "tokens", (F.col("generation") - F.when(F.col("turn") % 4 == 0, 1).otherwise(0)).alias("generation"))


@query(f"WITH {i.ENTRIES} SELECT name, CASE WHEN conv_id % 4 = 1 OR (conv_id % 3 = 0 AND turn % 4 <> 0) THEN 'quarantined' ELSE 'published' END AS state FROM entries")
def quarantine_exact(spark, d):
    return lifecycle.quarantined(states(spark, d), targets(spark, d)).select("name", "state")


@query(f"WITH {i.ENTRIES} SELECT name FROM entries WHERE conv_id % 4 <> 1 OR NOT (conv_id % 3 = 0 AND turn % 4 <> 0)")
def remove_quarantined(spark, d):
    return lifecycle.removed(states(spark, d), targets(spark, d), "quarantined").select("name")


@query(f"WITH {i.ENTRIES} SELECT count(*) FILTER (WHERE conv_id % 4 <> 1) AS published, count(*) FILTER (WHERE conv_id % 4 = 1) AS quarantined FROM entries")
def state_counts(spark, d):
    return lifecycle.state_counts(states(spark, d))


@query(
    f"WITH {i.ENTRIES}, p AS (SELECT * FROM entries WHERE conv_id % 4 <> 1), c AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.k > a.k AND b.tokens[1:a.k] = a.tokens) AND 1000 - last_used > 100),"
    " r AS (SELECT name, row_number() OVER w - 1 AS rank, coalesce(sum(size_bytes) OVER (ORDER BY k DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM c WINDOW w AS (ORDER BY k DESC, name)), t AS (SELECT count(*) AS n, sum(size_bytes) AS b FROM p),"
    " q AS (SELECT name, row_number() OVER (ORDER BY last_used, name) AS rank, count(*) OVER () AS n FROM entries WHERE conv_id % 4 = 1)"
    " SELECT name, CASE WHEN rank < n - 60 THEN 'cap' ELSE 'budget' END AS reason FROM r, t WHERE rank < n - 60 OR b - freed > 200000 UNION ALL SELECT name, 'tombstone' FROM q WHERE rank <= n - 60"
)
def evict_cold(spark, d):
    return lifecycle.evict_cold(states(spark, d), 60, 200_000, 1000, 100)


_LANES = "list_reduce(list_prepend({seed}::UHUGEINT, list_transform(w, lambda x: x::UHUGEINT)), lambda h, x: (xor(h, x) * {prime}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_HIGH, _LOW = (f"lpad(lower(to_hex({_LANES.format(seed=s, prime=p)})), 16, '0')" for s, p in ((0x9E3779B97F4A7C15, 0x880355F21E6D1965), (0xCBF29CE484222325, 0x100000001B3)))


def _le_words(text: str) -> str:
    """SQL: the bytes of ``text`` as 32-bit little-endian words, the last one padded."""
    h = f"rpad(hex(encode({text})), ((octet_length(encode({text})) + 3) // 4 * 8)::INT, '0')"
    return f"list_transform(range(0, (octet_length(encode({text})) + 3) // 4), lambda j: ('0x' || {h}[j * 8 + 7:j * 8 + 8] || {h}[j * 8 + 5:j * 8 + 6] || {h}[j * 8 + 3:j * 8 + 4] || {h}[j * 8 + 1:j * 8 + 2])::UBIGINT)"


@query(
    "WITH t AS (SELECT c_custkey, 'seg-' || c_mktsegment AS model, CASE WHEN c_custkey % 2 = 0 THEN 'KV-KV' ELSE '' END AS layout, CASE WHEN c_custkey % 3 = 0 THEN 'llama-cpp' ELSE '' END AS engine FROM customer),"
    " f AS (SELECT *, octet_length(encode(model)) || ':' || model || '3:tok3:f161:11:01:0' || CASE WHEN layout <> '' THEN '5:KV-KV' ELSE '' END AS fields FROM t),"
    f" w AS (SELECT c_custkey, list_concat(CASE WHEN engine <> '' THEN list_append({_le_words(chr(39) + '9:llama-cpp' + chr(39))}, 4294967295::UBIGINT) ELSE []::UBIGINT[] END, list_append({_le_words('fields')}, 4294967295::UBIGINT), [c_custkey::UBIGINT, (c_custkey * 7)::UBIGINT]) AS w FROM f)"
    f" SELECT c_custkey, {_HIGH} || {_LOW} AS blob_key FROM w"
)
def checkpoint_key(spark, d):
    """Keys of checkpoints: engine, fields and tokens folded."""
    c = i.table(spark, d, "customer")
    fp = {"model_id": F.concat(F.lit("seg-"), "c_mktsegment"), "tokenizer_hash": F.lit("tok"), "kv_dtype": F.lit("f16"), "kv_layout_version": F.lit(1), "cache_layout": F.when(F.col("c_custkey") % 2 == 0, "KV-KV").otherwise("")}
    tokens = F.array(F.col("c_custkey"), F.col("c_custkey") * 7).cast("array<bigint>")
    with keys.wrapping(spark):
        return c.select("c_custkey", keys.blob_key(fp, F.when(F.col("c_custkey") % 3 == 0, "llama-cpp"), tokens).alias("blob_key"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, 90000::BIGINT AS elapsed FROM events")
def event_millis(spark, d):
    ms = identity.utc_ms(F.col("ts"))
    return i.table(spark, d, "events").select("event_id", ms.alias("ms"), identity.elapsed_ms(ms, identity.utc_ms(F.col("ts") + F.expr("INTERVAL 90 SECONDS"))).alias("elapsed"))


# The key of the documents' checkpoints, registered in the catalogue.
ORACLE_SQL["blob_key"] = (
    "WITH t AS (SELECT doc_id, source AS model, CASE WHEN doc_id % 2 = 0 THEN 'KV-KV' ELSE '' END AS layout, doc_id % 3 = 0 AS other, list_transform(string_split(text, ' '), lambda x: length(x)::UBIGINT) AS tokens FROM documents),"
    " f AS (SELECT *, octet_length(encode(model)) || ':' || model || '3:tok3:f161:11:01:0' || CASE WHEN layout <> '' THEN '5:KV-KV' ELSE '' END AS fields FROM t),"
    f" w AS (SELECT doc_id, list_concat(CASE WHEN other THEN list_append({_le_words(chr(39) + '9:llama-cpp' + chr(39))}, 4294967295::UBIGINT) ELSE []::UBIGINT[] END, list_append({_le_words('fields')}, 4294967295::UBIGINT), tokens) AS w FROM f)"
    f" SELECT doc_id, {_HIGH} || {_LOW} AS blob_key, {_HIGH} AS high FROM w"
)
