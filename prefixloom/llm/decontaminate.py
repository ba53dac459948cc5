"""Benchmark decontamination by a prefix-filtered set join (operator 10), DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). A window
is a set of shingles (``SHINGLE`` consecutive words, hashed, each with its place in the window). To
contain a window a document must contain every shingle of it, so one shingle is a sufficient prefix:
the rarest by count over the whole corpus. Steps:

1. one pass over the texts keeps the places whose shingle stands in the benchmark, with the words
   around them; the texts themselves are not shuffled;
2. those places are counted by shingle, and every window chooses its rarest shingle;
3. the places of chosen shingles are joined to their windows; a place too near the text's start or
   end for the window is dropped (positional and length bounds);
4. the words around the place are compared with the window's words, exactly;
5. verified windows are gathered by document: words under any of them, items that own them.

Up to ``LITERAL_SHINGLES`` shingles the test in step 1 is a hash set in the plan (its size is counted
first); beyond, every place is exploded and joined with the shingle table by a shuffle. Windows are
broadcast up to ``BROADCAST_BYTES``, measured, else joined by shuffle too.

Defined results: a null text, a null item and texts without words match nothing; an item of fewer
words than a shingle is compared by shingles of its own length; very long texts are read whole, at a cost
linear in their words; repeated documents are judged row by row, repeated items all report; an item without an id counts as hit words only; extra columns pass
through ``contamination``, but for those named like RESULTS, which are replaced; an empty table of documents gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, others, written

WINDOW = 10
SHINGLE = 3
LITERAL_SHINGLES = 20_000
BROADCAST_BYTES = 16 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items", "contaminated")
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; null gives an empty array."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def hashes(words: str, k: int) -> Column:
    """Of the array column ``words``: the hash of the ``k`` words from each place on."""
    m = F.greatest(F.size(words) - (k - 1), F.lit(0))
    return F.transform(F.arrays_zip(*[F.slice(words, j + 1, m).alias(f"w{j}") for j in range(k)]), lambda z: F.xxhash64(z))


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """A row per item and different window: item_id, w (its words), k (its shingles' length)."""
    w = items.select(F.col(item_id).alias("item_id"), item_words(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (window - 1), F.lit(1)))
    w = w.select("item_id", "_words", F.explode(starts).alias("_at"))
    w = w.select("item_id", F.slice("_words", F.col("_at"), window).alias("w")).distinct()
    return w.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))


def window_shingles(own: DataFrame) -> DataFrame:
    """A row per window and place: w, k, sh (hash), off (its place in the window)."""
    by_k = F.coalesce(*[F.when(F.col("k") == k, hashes("w", k)) for k in range(1, SHINGLE + 1)])
    return own.select("w", "k", F.posexplode(by_k).alias("off", "sh"))


def places(docs: DataFrame, text: str, table: DataFrame, lengths: list[int], literal: list | None, window: int) -> DataFrame:
    """``docs`` without ``text``, with _dc_row, n_words and _dc_at: the places whose shingle is in ``table`` (k, sh).

    A place is (k, pos, sh, from, near): near are the words from place ``from`` on, enough for any window.
    ``literal``: the rows of ``table``, if they are few enough to stand in the plan.
    """
    kept = [F.col(c) for c in others(docs, text, *RESULTS)]
    rows = docs.select(*kept, F.monotonically_increasing_id().alias("_dc_row"), item_words(F.col(text)).alias("_dc_w"))
    size = F.size("_dc_w").cast("long").alias("n_words")

    def place(k: Column, p: Column, sh: Column) -> Column:
        first = F.greatest(p - (window - 1), F.lit(0))
        return F.struct(k.alias("k"), p.alias("pos"), sh.alias("sh"), first.alias("from"), F.slice("_dc_w", first + 1, F.lit(2 * window)).alias("near"))

    if literal is not None:

        def literally(k: int) -> Column:
            own = [r["sh"] for r in literal if r["k"] == k]
            pairs = F.transform(hashes("_dc_w", k), lambda h, i: F.when(h.isin(own), F.struct(h.alias("h"), i.alias("i"))))
            return F.transform(F.filter(pairs, lambda x: x.isNotNull()), lambda x: place(F.lit(k), x["i"], x["h"]))

        found = [literally(k) for k in lengths]
        at = F.concat(*found) if found else F.array().cast("array<struct<k:int,pos:int,sh:bigint,from:int,near:array<string>>>")
        return written(rows.select(*kept, "_dc_row", size, at.alias("_dc_at")))
    base = written(rows.select(*kept, "_dc_row", size, "_dc_w"))
    every = [base.select("_dc_row", F.lit(k).alias("k"), F.posexplode(hashes("_dc_w", k)).alias("pos", "sh")) for k in lengths]
    some = every[0]
    for more in every[1:]:
        some = some.unionByName(more)
    hit = some.join(table, ["k", "sh"], "left_semi").groupBy("_dc_row").agg(F.collect_list(F.struct("k", "pos", "sh")).alias("_dc_hit"))
    at = F.transform(F.coalesce("_dc_hit", F.array().cast("array<struct<k:int,pos:int,sh:bigint>>")), lambda x: place(x["k"], x["pos"], x["sh"]))
    return written(base.join(hit, "_dc_row", "left").select(*kept, "_dc_row", "n_words", at.alias("_dc_at")))


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, literal_shingles: int = LITERAL_SHINGLES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_hit, n_items, items (sorted array of strings) and contaminated."""
    own = written(windows(items, item_text, item_id, window))
    shingles = window_shingles(own.select("w", "k").distinct())
    table = shingles.select("k", "sh").distinct()
    few = table.limit(literal_shingles + 1).collect()  # at most that many rows of two numbers
    bounded = len(few) <= literal_shingles
    lengths = sorted({r["k"] for r in few}) if bounded else [r["k"] for r in table.select("k").distinct().orderBy("k").collect()]
    base = places(docs, text, table, lengths, few if bounded else None, window)
    at = base.select("_dc_row", "n_words", F.explode("_dc_at").alias("at")).select("_dc_row", "n_words", "at.*")
    counts = at.groupBy("k", "sh").agg(F.count("*").alias("n"))
    # The rarest shingle of each window; none of a window's shingles may be missing from the corpus.
    ranked = shingles.join(counts, ["k", "sh"], "left").groupBy("k", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "sh")).alias("p"))
    owners = own.groupBy("w").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    prefix = written(ranked.where("p.n > 0").join(owners, "w").select("k", "p.sh", "p.off", "w", "ids"))
    # A row per window, with its words and owners: few shingles can make many windows, so their bytes are summed.
    row = F.lit(64) + F.size("w") * 24 + F.octet_length(F.array_join("w", "")) + F.size("ids") * 24 + F.octet_length(F.array_join("ids", ""))
    if prefix.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0] <= broadcast_bytes:
        prefix = F.broadcast(prefix)
    start = F.col("pos") - F.col("off")
    near = at.join(prefix, ["k", "sh"]).where((start >= 0) & (start + F.size("w") <= F.col("n_words")))
    same = near.where(F.slice("near", start - F.col("from") + 1, F.size("w")) == F.col("w"))
    spans = same.select("_dc_row", F.struct(start.alias("a"), F.size("w").alias("n")).alias("span"), "ids")
    hit = spans.groupBy("_dc_row").agg(F.collect_set("span").alias("_dc_spans"), F.collect_set("ids").alias("_dc_ids"))
    under = F.array_distinct(F.flatten(F.transform("_dc_spans", lambda s: F.sequence(s["a"], s["a"] + s["n"] - 1))))
    found = hit.select("_dc_row", F.size(under).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("_dc_ids"))).alias("items"))
    kept = [base[c] for c in others(base, "_dc_at", "_dc_row")]
    n_hit, ids = F.coalesce(found["n_hit"], F.lit(0)), F.coalesce(found["items"], F.array().cast("array<string>"))
    j = base.drop("_dc_at").join(found, "_dc_row", "left")
    return j.select(*kept, n_hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"))
