"""Queries over payload layouts and the chunk store, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import layout, segments
from . import inputs as i
from .registry import query

HEX, TURNED = "0123456789ABCDEF", "123456789ABCDEF0"


def head_major(spark, d):
    """convo, turn, blob, payload, positions, spans: a header, a tensor of four heads that grows by a position per hex digit, a codebook without heads."""
    p = i.payloads(spark, d)
    streams = [F.col("payload")]
    for _ in range(3):
        streams.append(F.translate(streams[-1], HEX, TURNED))
    n = F.length("payload").cast("bigint")
    payload = F.concat(F.lit("HEADER::"), *streams, F.lit("CODES"))
    span = lambda name, begin, end, heads: F.struct(F.lit(name).alias("tensor"), begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end"), F.lit(heads).cast("bigint").alias("n_heads"))
    spans = F.array(span("v.codebook", 4 * n + 8, 4 * n + 13, 1), span("k", F.lit(8), 4 * n + 8, 4))
    return p.select("convo", "turn", "blob", payload.cast("binary").alias("payload"), n.alias("positions"), spans.alias("spans"))


_HEADS = "pay AS (SELECT conv_id AS convo, turn, 'c' || conv_id || '-t' || turn AS blob, string_agg(hex(text), '') OVER (PARTITION BY conv_id ORDER BY turn) AS s0 FROM conversations), heads AS (SELECT *, length(s0) AS n, {0} AS s1, {1} AS s2, {2} AS s3 FROM pay)".format(
    *("translate(" * k + "s0" + f", '{HEX}', '{TURNED}')" * k for k in (1, 2, 3))
)
_GRID = f"""{_HEADS}, grid AS (
  SELECT convo, turn, blob, 'k' AS tensor, sha256(substring(s0, i * 64 + 1, 64) || substring(s1, i * 64 + 1, 64) || substring(s2, i * 64 + 1, 64) || substring(s3, i * 64 + 1, 64)) AS digest,
         4 * least(64, n - i * 64) AS size, least(64, n - i * 64) AS per_head_len, 4 AS n_heads, 8 + i * 64 AS first_off, n AS head_stride FROM heads, unnest(range(0, (n + 63) // 64)) AS u(i)
  UNION ALL SELECT convo, turn, blob, 'v.codebook', sha256('CODES'), 5, 5, 1, 4 * n + 8, 0 FROM heads
  UNION ALL SELECT convo, turn, blob, NULL, sha256('HEADER::'), 8, 8, 1, 0, 0 FROM heads)"""


@query(f"WITH {_GRID} SELECT blob, tensor, digest, size::BIGINT AS size, per_head_len::BIGINT AS per_head_len, n_heads::BIGINT AS n_heads, first_off::BIGINT AS first_off, head_stride::BIGINT AS head_stride FROM grid")
def token_block_chunks(spark, d):
    return layout.token_blocks(head_major(spark, d)).select("blob", "tensor", "digest", "size", "per_head_len", "n_heads", "first_off", "head_stride")


@query(
    f"WITH {_GRID}, f AS (SELECT convo, digest, min(turn) AS first FROM grid GROUP BY ALL), per AS (SELECT convo, turn, coalesce(sum(size) FILTER (WHERE turn = first), 0)::BIGINT AS new_bytes, sum(size)::BIGINT AS payload_bytes FROM grid JOIN f USING (convo, digest) GROUP BY convo, turn)"
    " SELECT *, round(new_bytes / payload_bytes, 4) AS new_frac FROM per"
)
def token_block_growth(spark, d):
    """New bytes per turn where blocks of positions are the chunks."""
    return ch.new_bytes_per_turn(layout.token_blocks(head_major(spark, d)))


def _stretches(scope: str) -> str:
    if scope == "file":
        return "SELECT convo, turn, blob, NULL AS tensor, 0 AS head, 0 AS begin, 'HEADER::' || s0 || s1 || s2 || s3 || 'CODES' AS s FROM heads"
    book = "SELECT convo, turn, blob, 'v.codebook', 0, 4 * n + 8, 'CODES' FROM heads"
    if scope == "tensor":
        return f"SELECT convo, turn, blob, 'k' AS tensor, 0 AS head, 8 AS begin, s0 || s1 || s2 || s3 AS s FROM heads UNION ALL {book}"
    return f"SELECT convo, turn, blob, 'k' AS tensor, h AS head, 8 + h * n AS begin, [s0, s1, s2, s3][h + 1] AS s FROM heads, unnest(range(0, 4)) AS u(h) UNION ALL {book}"


def _blocks(scope: str, size: int) -> str:
    return (
        f"SELECT convo, turn, blob, tensor, head, (begin + least((i + 1) * {size}, length(s)))::BIGINT AS end_off, length(substring(s, i * {size} + 1, {size}))::BIGINT AS size, sha256(substring(s, i * {size} + 1, {size})) AS digest"
        f" FROM ({_stretches(scope)}), unnest(range(0, (length(s) + {size - 1}) // {size})) AS u(i)"
    )


def blocks_of(size: int):
    """A chunker: fixed blocks with their ends."""
    return lambda rows: ch.fixed_blocks(rows, size).withColumn("end_off", F.col("chunk_no") * size + F.col("size"))


@query(f"WITH {_HEADS} SELECT blob, tensor, head::INT AS head, end_off, size, digest FROM ({_blocks('head', 256)})")
def head_scope_chunks(spark, d):
    return layout.scoped(head_major(spark, d), "head", blocks_of(256)).select("blob", "tensor", "head", "end_off", "size", "digest")


@query(f"WITH {_HEADS} SELECT blob, tensor, head::INT AS head, end_off, size, digest FROM ({_blocks('tensor', 1000)})")
def tensor_scope_chunks(spark, d):
    return layout.scoped(head_major(spark, d), "tensor", blocks_of(1000)).select("blob", "tensor", "head", "end_off", "size", "digest")


_CONFIGS = " UNION ALL ".join(
    ["SELECT 'token-block/64' AS config, convo, turn, blob, size, digest FROM grid"] + [f"SELECT 'fixed/{s}/{n}', convo, turn, blob, size, digest FROM ({_blocks(s, n)})" for s in ("head", "tensor", "file") for n in (256, 1024)]
)


@query(
    f"WITH {_GRID}, c AS ({_CONFIGS}), f AS (SELECT config, convo, digest, min(turn) AS first FROM c GROUP BY ALL),"
    " per AS (SELECT config, convo, turn, coalesce(sum(size) FILTER (WHERE turn = first), 0) AS new_bytes, sum(size) AS payload_bytes FROM c JOIN f USING (config, convo, digest) GROUP BY ALL),"
    " t AS (SELECT config, convo, min(turn) AS t, count(*) AS turns FROM per GROUP BY ALL)"
    " SELECT config, convo, max(turns) AS turns, round(sum(new_bytes) FILTER (WHERE turn > t) / sum(payload_bytes) FILTER (WHERE turn > t), 4) AS mean_new_frac, sum(new_bytes)::BIGINT AS unique_bytes FROM per JOIN t USING (config, convo) WHERE turns >= 2 GROUP BY config, convo"
)
def chunker_grid(spark, d):
    """Chunkers and scopes beside each other, by conversation: the chunks of all go through one plan, which the driver holds once."""
    blobs = head_major(spark, d)
    made = {"token-block/64": layout.token_blocks(blobs)} | {f"fixed/{s}/{n}": layout.scoped(blobs, s, blocks_of(n)) for s in ("head", "tensor", "file") for n in (256, 1024)}
    rows = [c.select(F.lit(name).alias("config"), "convo", "turn", F.unhex("digest").alias("digest"), "size") for name, c in made.items()]
    by = ("config", "convo")
    return ch.mean_new_frac(ch.new_bytes_per_turn(reduce(DataFrame.unionByName, rows), by), by)


@query()
def head_boundary_stability(spark, d):
    """Content-defined cuts within each head that come again in the next turn."""
    c = layout.scoped(head_major(spark, d), "head", lambda rows: ch.content_defined(rows, 1024))
    return ch.stability(c.where("tensor = 'k'"), ("convo", "head"))


@query(f"WITH {_HEADS} SELECT blob, sha256('HEADER::' || s0 || s1 || s2 || s3 || 'CODES') AS digest FROM heads")
def scatter_reassemble(spark, d):
    """Payloads put together again from blocks of positions, head by head."""
    blobs = head_major(spark, d)
    refs = layout.token_blocks(blobs)
    heads = F.sequence(F.lit(0).cast("bigint"), F.col("n_heads") - 1)
    slices = F.transform(heads, lambda h: F.substring("payload", (F.col("first_off") + h * F.col("head_stride") + 1).cast("int"), F.col("per_head_len").cast("int")))
    j = refs.join(blobs.select("blob", "payload"), "blob")
    bodies = j.select("digest", F.aggregate(slices, F.lit(b""), lambda a, x: F.concat(a, x)).alias("body"))
    manifest = refs.join(blobs.select("blob", F.octet_length("payload").cast("bigint").alias("payload_len")), "blob")
    return layout.scattered(manifest, bodies).select("blob", F.sha2("payload", 256).alias("digest"))


# The chunk store


def store(spark, d):
    c = ch.fixed_blocks(i.payloads(spark, d), 256)
    live = c.where("turn % 2 = 0").select("blob").distinct()
    return c, i.records(c), segments.live_digests(c, live)


@query(f"WITH {i.CHUNKS}, live AS (SELECT DISTINCT blob FROM chunks WHERE turn % 2 = 0) SELECT digest, count(*) AS refs FROM chunks JOIN live USING (blob) GROUP BY digest")
def registered_refs(spark, d):
    return store(spark, d)[2]


@query(
    f"WITH {i.CHUNKS}, old AS (SELECT DISTINCT digest FROM chunks WHERE turn % 3 = 0), fresh AS (SELECT digest, max(size) AS body_len FROM chunks WHERE digest NOT IN (SELECT digest FROM old) GROUP BY digest),"
    " a AS (SELECT *, coalesce(sum(body_len + 36) OVER (ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM fresh), s AS (SELECT *, o // 8184 AS k FROM a)"
    " SELECT (k + 8)::BIGINT AS seg, (o - min(o) OVER (PARTITION BY k) + 8)::BIGINT AS rec_off, body_len::BIGINT AS body_len, digest FROM s"
)
def staged_records(spark, d):
    c = ch.fixed_blocks(i.payloads(spark, d), 256)
    old = c.where("turn % 3 = 0").select("digest", F.col("size").alias("body_len")).distinct()
    return segments.staged(old, c.select("digest", F.col("size").alias("body_len")), 8192, 7)


@query(f"WITH {i.RECORDS} SELECT seg, rec_off, body_len, digest FROM records WHERE seg IN (SELECT seg FROM stats WHERE live_records > 0 OR seg = 1)")
def gc_empty_segments(spark, d):
    _, records, live = store(spark, d)
    return segments.collected(records, live, 1)[0]


_PLAN = f"""{i.RECORDS}, plan AS (SELECT seg, total, (SELECT max(seg) FROM records) + row_number() OVER (ORDER BY dead DESC, seg) AS new_seg FROM (SELECT * FROM stats WHERE seg <> 5 AND live_records > 0 AND dead > 0 AND dead >= 0.1 * total ORDER BY dead DESC, seg LIMIT 2)),
moved AS (SELECT new_seg AS seg, p.seg AS old, total, coalesce(sum(body_len + 36) OVER (PARTITION BY p.seg ORDER BY rec_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8 AS rec_off, body_len, digest FROM placed p JOIN live USING (digest) JOIN plan ON plan.seg = p.seg WHERE here)"""
COMPACT = segments.CompactConfig(ratio=0.1, min_dead_bytes=1, max_segments=2)


@query(f"WITH {_PLAN} SELECT seg::BIGINT AS seg, rec_off::BIGINT AS rec_off, body_len, digest FROM (SELECT seg, rec_off, body_len, digest FROM records WHERE seg NOT IN (SELECT seg FROM plan) UNION ALL SELECT seg, rec_off, body_len, digest FROM moved)")
def compact_rewrite(spark, d):
    _, records, live = store(spark, d)
    return segments.compacted(records, live, 5, COMPACT)[0]


@query(f"WITH {_PLAN} SELECT old AS seg, seg::BIGINT AS new_seg, count(*) AS moved, (max(total) - sum(body_len + 36))::BIGINT AS reclaimed FROM moved GROUP BY ALL")
def compact_receipts(spark, d):
    _, records, live = store(spark, d)
    return segments.compacted(records, live, 5, COMPACT)[1]


@query(
    f"WITH {_PLAN.replace('seg <> 5 AND ', '')} SELECT (SELECT count(*) FROM plan) AS segments, (SELECT sum(t - b) FROM (SELECT max(total) AS t, sum(body_len + 36) AS b FROM moved GROUP BY old))::BIGINT AS reclaimed,"
    " coalesce((SELECT sum(total) FROM stats WHERE live_records = 0), 0)::BIGINT AS collected"
)
def sweep_receipt(spark, d):
    _, records, live = store(spark, d)
    return segments.swept(records, live, COMPACT)[1]


@query(f"WITH {i.CHUNKS} SELECT blob, sum(size)::BIGINT AS gross_bytes, count(*) AS refs FROM chunks GROUP BY blob")
def gross_bytes(spark, d):
    return segments.gross_bytes(ch.fixed_blocks(i.payloads(spark, d), 256))


_FILES = "SELECT CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id || '.ckpt' WHEN 1 THEN 'd' || doc_id // 5 * 5 || '.ckm' WHEN 2 THEN 's' || doc_id || '.seg' WHEN 3 THEN 'd' || doc_id || '.ckpt.tmp0' ELSE 'notes' END AS name, n_chars AS length, doc_id FROM documents"


def files(spark, d):
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("d"), n, F.lit(".ckpt"))).when(k == 1, F.concat(F.lit("d"), (F.col("doc_id") - 1).cast("string"), F.lit(".ckm"))).when(k == 2, F.concat(F.lit("s"), n, F.lit(".seg")))
    name = name.when(k == 3, F.concat(F.lit("d"), n, F.lit(".ckpt.tmp0"))).otherwise("notes")
    return i.table(spark, d, "documents").select(name.alias("name"), F.col("n_chars").alias("length"), "doc_id")


@query(f"WITH f AS ({_FILES}) SELECT CASE doc_id % 5 WHEN 0 THEN 'checkpoint' WHEN 1 THEN 'manifest' WHEN 2 THEN 'segment' WHEN 3 THEN 'temporary' ELSE 'other' END AS kind, count(*) AS files, sum(length)::BIGINT AS bytes FROM f GROUP BY 1")
def physical_bytes(spark, d):
    return segments.physical_bytes(files(spark, d))


@query(f"WITH f AS ({_FILES}) SELECT a.name[:-6] AS stem, a.name AS checkpoint, b.name AS manifest FROM f a JOIN f b ON a.name LIKE '%.ckpt' AND b.name = a.name[:-6] || '.ckm'")
def live_manifest_pairs(spark, d):
    return segments.live_manifests(files(spark, d))


@query(f"WITH f AS ({_FILES}) SELECT name FROM f WHERE doc_id % 5 = 3 AND doc_id < 300")
def stale_temporaries(spark, d):
    return segments.stale_temporaries(files(spark, d), F.lit(300), modified="doc_id").select("name")


@query("SELECT arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents")
def largest_blob(spark, d):
    t = i.table(spark, d, "documents")
    return t.agg(F.max_by("doc_id", F.col("n_chars") * 1_000_000 - F.col("doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))
