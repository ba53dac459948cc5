"""Longest-prefix matching and its relatives as equi-joins on the blocks of token arrays, all built in.

Tokens are cut into blocks of ``BLOCK``. A place in a prompt is a head (the digest of the whole blocks
before) and a tail of at most ``BLOCK`` tokens, so a prompt is one row per block that carries its tokens
once, however many lengths the entries have. Entries live at the block that holds their last token: the
lengths of tails known at a head are a list of at most ``BLOCK`` numbers, and a prompt is expanded to those
alone. Entries are reduced to one per key before they are joined, so neither hot prefixes nor equal
entries multiply rows; a hot head is a skewed join key, which adaptive execution splits.

Heads and tails are compared by digests of 128 bits (two lanes of xxhash64), like the keys of
checkpoints: of 10 ** 10 different prefixes two agree with a probability under 10 ** -18. No tokens are
joined back to be compared. Tokens are never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import UNKNOWN

DOMAIN = ("engine", "fp")
BLOCK = 64
NODE = ("_b", "_h")


def _digest(tokens: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(3), tokens).alias("a"), F.xxhash64(F.lit(5), tokens).alias("b"))


def _lane(blocks: Column, seed: int) -> Column:
    """The running digest before each block."""
    before = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.aggregate(before, F.array(F.lit(seed).cast("long")), lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x))))


def _cut(tokens: str) -> Column:
    at = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(tokens, i * BLOCK + 1, BLOCK))


def _blocks(df: DataFrame, tokens: str) -> DataFrame:
    """``df`` without ``tokens``, once per block: _b (its number), _h (its head), _x (its tokens)."""
    kept = [c for c in df.columns if c != tokens]
    cut = df.select(*kept, _cut(tokens).alias("_cut"))
    rows = F.arrays_zip(_lane(F.col("_cut"), 1).alias("a"), _lane(F.col("_cut"), 2).alias("b"), F.col("_cut").alias("x"))
    # The outer form: Spark filters empty arrays before an inner one, and would compute them again for that.
    rows = cut.select(*kept, F.posexplode_outer(rows).alias("_b", "_z")).where("_z IS NOT NULL")
    return rows.select(*kept, "_b", F.struct("_z.a", "_z.b").alias("_h"), F.col("_z.x").alias("_x"))


def _ends(entries: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``entries`` with the block that holds the last token: _b, _h, _t (the tail, its tokens up to the last), _l (how many)."""
    lane = lambda seed: F.aggregate(F.slice("_cut", 1, F.size("_cut") - 1), F.lit(seed).cast("long"), lambda a, x: F.xxhash64(a, x))
    cut = entries.where(F.size(tokens) > 0).withColumn("_cut", _cut(tokens))
    return cut.withColumns({"_b": F.size("_cut") - 1, "_h": F.struct(lane(1).alias("a"), lane(2).alias("b")), "_t": F.element_at("_cut", -1)}).withColumn("_l", F.size("_t")).drop("_cut")


def _at_tails(blocks: DataFrame, ends: DataFrame, *keys: str) -> DataFrame:
    """``blocks`` once per tail length that ``ends`` has at their head: _l, _c (the tail's digest) and _k (the prefix's length); _x stays."""
    lengths = ends.groupBy(*keys, *NODE).agg(F.collect_set("_l").alias("_ls"))
    rows = blocks.join(lengths, [*keys, *NODE]).withColumn("_l", F.explode(F.filter("_ls", lambda n: n <= F.size("_x")))).drop("_ls")
    return rows.withColumns({"_c": _digest(F.slice("_x", 1, F.col("_l"))), "_k": F.col("_b") * BLOCK + F.col("_l")})


def _best(entries: DataFrame, *keys: str) -> DataFrame:
    """One entry per key: the last used, then the least last token, then the least name."""
    order = F.struct((-F.col("last_used")).alias("u"), F.element_at("_t", -1).alias("t"), "name")
    return entries.groupBy(*keys).agg(F.min(order).alias("_e"))


def one_per_domain(entries: DataFrame) -> DataFrame:
    """A daemon's slots: of the entries at the same tokens and engine the newest generation, whatever its fingerprint."""
    order = F.struct("generation" if "generation" in entries.columns else "last_used", "name")
    newest = entries.groupBy("engine", "tokens").agg(F.max(order).alias("_n")).select(F.col("_n.name").alias("name"))
    return entries.join(newest, "name", "left_semi")


def matches(requests: DataFrame, entries: DataFrame, semantics: str = "store", fingerprint_gate: bool = True) -> DataFrame:
    """``requests`` (request_id, engine, fp, tokens) with entry, matched_tokens and on_path; null, 0, null without a match.

    ``entries``: name, engine, fp, tokens, granularity (1: whole context only), last_used; published ones.
    On the path an entry is a prefix of the request; end-anchored it differs in its last token only.
    The longer wins, then the one on the path, then the last used, the least last token, the least name.
    Entries and requests of unknown identity (fp ``missing`` or ``unresolved``) match nothing. With
    ``semantics="daemon"`` an engine holds one entry per tokens (``one_per_domain``), and
    ``fingerprint_gate=False`` matches across fingerprints of an engine.
    """
    if semantics not in ("store", "daemon"):
        raise ValueError(f"semantics is store or daemon, not {semantics}")
    domain = DOMAIN if fingerprint_gate else DOMAIN[:1]
    known = lambda df: df.where(~F.col("fp").isin(*UNKNOWN)) if dict(df.dtypes)["fp"] == "string" else df
    e = known(entries).where(F.size("tokens") >= 2)
    e = _ends(one_per_domain(e) if semantics == "daemon" else e).withColumn("_w", F.col("granularity") == 1)
    r = known(requests).select("request_id", *domain, F.size("tokens").alias("_n"), "tokens")
    r = _at_tails(_blocks(r, "tokens"), e, *domain)
    # One key for both rules: the whole tail, or the tail but its last token (off the path).
    key = lambda off, tokens: F.struct(F.lit(off).alias("off"), _digest(tokens).alias("c"))
    both = lambda tail: F.array(key(False, tail), key(True, F.slice(tail, F.lit(1), F.size(tail) - 1)))
    tail = F.slice("_x", 1, F.col("_l"))
    r = r.drop("_c").select("request_id", *domain, *NODE, "_l", "_k", "_n", F.element_at("_x", F.col("_l")).alias("_last"), F.explode_outer(both(tail)).alias("_key"))
    e = e.withColumn("_key", F.explode_outer(both(F.col("_t")))).where(~F.col("_key.off") | ~F.col("_w"))
    best = _best(e, *domain, *NODE, "_l", "_key", "_w")
    # If the best off the path has the request's own last token it is on the path, and wins there.
    fits = F.when(F.col("_key.off"), F.col("_e.t") != F.col("_last")).otherwise(~F.col("_w") | (F.col("_k") == F.col("_n")))
    m = r.join(best, [*domain, *NODE, "_l", "_key"]).where(fits)
    won = m.groupBy("request_id").agg(F.min(F.struct((-F.col("_k")).alias("m"), F.col("_key.off").alias("off"), "_e.u", "_e.t", "_e.name")).alias("w"))
    j = requests.join(won, "request_id", "left")
    return j.withColumns({"entry": F.col("w.name"), "matched_tokens": F.coalesce(-F.col("w.m"), F.lit(0)).cast("long"), "on_path": ~F.col("w.off")}).drop("w")


def arbitrated(requests: DataFrame, memory: DataFrame, disk: DataFrame) -> DataFrame:
    """``requests`` with source (memory, disk or null), entry and covered: the disk's match serves only if it covers more than the memory's."""
    side = lambda e, name: matches(requests, e).select("request_id", F.struct("entry", "matched_tokens", F.greatest(F.col("matched_tokens") - 1, F.lit(0)).alias("covered")).alias(name))
    j = requests.join(side(memory, "_m"), "request_id").join(side(disk, "_d"), "request_id")
    served = F.when((F.col("_d.matched_tokens") >= 2) & (F.col("_d.covered") > F.col("_m.covered")), "disk").when(F.col("_m.matched_tokens") >= 2, "memory")
    j = j.withColumn("source", served)
    entry = F.when(served == "disk", F.col("_d.entry")).when(served == "memory", F.col("_m.entry"))
    covered = F.when(served == "disk", F.col("_d.covered")).when(served == "memory", F.col("_m.covered")).otherwise(0)
    return j.withColumns({"entry": entry, "covered": covered.cast("long")}).drop("_m", "_d")


def exact(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """``entries`` whose tokens are those of a row of ``keys`` (tokens)."""
    return entries.join(keys.select("tokens").distinct(), "tokens", "left_semi")


def touched(requests: DataFrame, entries: DataFrame, seq: str) -> DataFrame:
    """name, last_seq: the last request (by ``seq``) that passes each entry on its path, or is served it end-anchored.

    This is the recency of an index that touches whole paths; ``matches`` alone gives the winners.
    """
    e = _ends(entries.where(F.size("tokens") >= 2)).withColumn("_c", _digest(F.col("_t")))
    r = requests.select(*DOMAIN, F.col(seq).alias("_seq"), F.size("tokens").alias("_n"), "tokens")
    r = _at_tails(_blocks(r, "tokens"), e, *DOMAIN)
    # The last request at each key, before entries are joined.
    last = r.groupBy(*DOMAIN, *NODE, "_l", "_c").agg(F.max("_seq").alias("_any"), F.max(F.when(F.col("_k") == F.col("_n"), F.col("_seq"))).alias("_same"))
    passed = e.join(last, [*DOMAIN, *NODE, "_l", "_c"]).select("name", F.when(F.col("granularity") == 1, F.col("_same")).otherwise(F.col("_any")).alias("_seq"))
    served = matches(requests, entries).where("NOT on_path").select(F.col("entry").alias("name"), F.col(seq).alias("_seq"))
    return passed.where("_seq IS NOT NULL").unionByName(served).groupBy("name").agg(F.max("_seq").alias("last_seq"))


def subtree(entries: DataFrame, key: list) -> DataFrame:
    """Entries at ``key`` or below it, and those of its length that differ in the last token only; all for an empty key."""
    if not key:
        return entries
    k = len(key)
    lit = F.array(*[F.lit(x) for x in key])
    same = F.slice("tokens", 1, k) == lit
    near = (F.size("tokens") == k) & (F.slice("tokens", 1, k - 1) == F.slice(lit, 1, k - 1))
    return entries.where(same | near)


def with_anchor(entries: DataFrame) -> DataFrame:
    """``entries`` with is_anchor: some other entry strictly extends it, whatever its engine or fingerprint."""
    e = _ends(entries.select("name", "tokens")).withColumn("_c", _digest(F.col("_t")))
    r = _blocks(entries.select(F.size("tokens").alias("_n"), "tokens"), "tokens")
    longer = _at_tails(r, e).where(F.col("_k") < F.col("_n")).select(*NODE, "_l", "_c").distinct()
    found = e.join(longer, [*NODE, "_l", "_c"], "left_semi").select("name").distinct().withColumn("is_anchor", F.lit(True))
    return entries.join(found, "name", "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))


def declared_lcp(requests: DataFrame, group: str, seq: str = "seq", tokens: str = "tokens") -> DataFrame:
    """(``group``, ``seq``, declared_lcp): the longest prefix shared with any earlier request of the group.

    Not pairs of requests: the first request at each head tells how many whole blocks are shared; then,
    only at heads where some request leaves the others, the first request at each tail.
    """
    p = _blocks(requests.select(group, seq, F.col(tokens).alias("_tokens")), "_tokens")
    first = p.groupBy(group, *NODE).agg(F.min(seq).alias("_first"))
    shared = p.join(first, [group, *NODE]).where(F.col("_first") < F.col(seq))
    last = shared.groupBy(group, seq).agg(F.max(F.struct(*NODE)).alias("_m")).select(group, seq, "_m.*")
    there = p.join(last.select(group, *NODE).distinct(), [group, *NODE], "left_semi")
    tails = there.select(group, seq, *NODE, "_x", F.explode(F.sequence(F.lit(1), F.size("_x"))).alias("_l")).withColumn("_c", _digest(F.slice("_x", 1, F.col("_l")))).drop("_x")
    earliest = tails.groupBy(group, *NODE, "_l", "_c").agg(F.min(seq).alias("_first"))
    found = tails.join(last, [group, seq, *NODE], "left_semi").join(earliest, [group, *NODE, "_l", "_c"]).where(F.col("_first") < F.col(seq))
    best = last.join(found.groupBy(group, seq).agg(F.max("_l").alias("_l")), [group, seq], "left").select(group, seq, (F.col("_b") * BLOCK + F.coalesce("_l", F.lit(0))).alias("_n"))
    return requests.select(group, seq).join(best, [group, seq], "left").select(group, seq, F.coalesce("_n", F.lit(0)).cast("long").alias("declared_lcp"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)).cast("long")
