"""Near copies by Jaccard similarity of word shingles, for the pipeline's near-dedup stage.

Two texts are linked if the sets of their ``SHINGLE``-word shingles (words as in ``simhash``, shingles as
XXH64) have a Jaccard similarity of ``SIMILARITY`` or more; links form components. Candidates come by
operator 1's method: SimHash prints, shards by bands of their bits, BK-trees, links within a radius,
components. At this similarity a bit differs in 15 % of cases (``RATES``), which no radius of 64 bits
tells from chance, so prints are wider: the ``NAMED`` first words are searched, within ``RADIUS`` bits
(a pair at 0.8 lies farther apart in under 5 of 100,000 cases, unrelated ones nearer in 2 of 10 ** 8), and
bands are dealt from as many bits as they need. Bands widen with the table, so that one value holds some
``LOAD`` texts, and their number is such that a pair at 0.8 shares none in ``MISSED`` of cases at most.
All pairs of different sets in a component of candidates are then compared in full, unless links already join them.

Texts with the same set are one node, named by 128 bits of its hash. Only sets with candidates are sent (a bitmap of their keys turns
other texts away before the shuffle, ``keyset``), and a component of more than ``PART`` sets is cut into parts, each pair of parts a unit of its own.

Defined results: a text of under ``SHINGLE`` words is one shingle; null, empty and blank texts are copies
of one another; very long texts are read whole; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import keyset, simhash
from .common import written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Of sets up to this many shingles, the share of bits that differ in a pair at the similarity, at most: counted for every split into common and own shingles (ties weigh in small sets).
RATES = ((5, 0.1875), (30, 0.1612), (math.inf, 0.156))
MISSED = 5e-5
LOAD = 64
#: Words of a print that the BK-trees hold, and the radius in their bits.
NAMED, RADIUS = 3, 58
PART = 500
SEED = 42
SIGNED = StructType([StructField("node", BinaryType()), StructField("fp", BinaryType()), StructField("bands", ArrayType(IntegerType()))])


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of the text's shingles as hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)], np.uint64))


def width(n: int) -> int:
    """Bits of a band for a table of ``n`` rows."""
    return min(30, max(4, math.ceil(math.log2(max(n, 1) / LOAD))))


def number(size: int, width: int) -> int:
    """Bands of ``width`` bits that a set of ``size`` shingles is dealt by; no set of one shingle to three has a near one."""
    if size < 4:
        return 0
    rate = next(r for most, r in RATES if size <= most)
    return math.ceil(math.log(MISSED) / math.log1p(-((1 - rate) ** width)))


def signed(own: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """The first words of the set's print, and its bands' values in order of the bands."""
    bands = number(len(own), width)
    bits = simhash.wide(own, max(NAMED, -(-bands * width // 64)))
    return np.packbits(bits[: 64 * NAMED], bitorder="little").tobytes(), bits[: bands * width].reshape(bands, width) @ (1 << np.arange(width, dtype=np.int32))


def _signed(width: int) -> Callable[[str], Column]:
    @pandas_udf(SIGNED)
    def made(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        prints = [signed(s, width) for s in sets]
        return pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "fp": [p for p, _ in prints], "bands": [b for _, b in prints]})

    return made


@pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts])


def linked(sets: list[np.ndarray], part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links enough to join all similar ones of ``sets``; with ``part``, those between parts that join what links within the parts don't."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    pairs, here = [np.zeros((2, 0), np.int64)], np.zeros(len(words), np.int64)
    for i in range(n - 1):
        own = ids[starts[i] : starts[i] + size[i]]
        here[own] = 1
        both = np.add.reduceat(here[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        here[own] = 0
        j = np.flatnonzero(both >= SIMILARITY * (size[i] + size[i + 1 :] - both) - 1e-9) + i + 1
        pairs.append(np.stack([np.full(len(j), i), j]))
    a, b = np.concatenate(pairs, axis=1)
    if part is not None:
        own = part[a] == part[b]
        label = simhash.spanning(a[own], b[own], n)[1]
        a, b = a[~own], b[~own]
        kept = simhash.spanning(label[a], label[b], n)[0]
    else:
        kept = simhash.spanning(a, b, n)[0]
    return list(zip(a[kept].tolist(), b[kept].tolist()))


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Holds a batch and one unit: the rows of an unfinished unit are kept for the next batch."""

    def links(unit: pd.DataFrame) -> list[tuple[int, int]]:
        node = unit["node"].tolist()
        cross = unit["a"].iat[0] != unit["b"].iat[0]
        pairs = linked([np.frombuffer(s, np.uint64) for s in unit["own"]], unit["part"].to_numpy() if cross else None) if len(node) > 1 else []
        return [(node[i], node[j]) for i, j in pairs]

    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if not len(rows):
            continue
        new = np.ones(len(rows), bool)
        new[1:] = (rows[["band", "a", "b"]].to_numpy()[1:] != rows[["band", "a", "b"]].to_numpy()[:-1]).any(1)
        at = np.flatnonzero(new)
        kept = rows.iloc[at[-1] :]
        out = [p for x, y in zip(at[:-1], at[1:]) for p in links(rows.iloc[x:y])]
        yield pd.DataFrame(out, columns=["u", "v"], dtype=object)
    if kept is not None:
        yield pd.DataFrame(links(kept), columns=["u", "v"], dtype=object)


def near_copies(docs: DataFrame, key: str, part: int = PART) -> DataFrame:
    """doc_id, ``key`` and root (binary, the same in all of a group of near copies) of every row of ``docs`` (doc_id, text, ``key``); ``key`` tells texts apart."""
    bits = width(docs.count())
    made = written(docs.select("doc_id", key, _signed(bits)("text").alias("s")).select("doc_id", key, "s.*"))
    shards = made.select("node", "fp", "bands").dropDuplicates(["node"]).select("fp", F.posexplode("bands").alias("band", "value"))
    shards = shards.select("fp", F.shiftleft(F.col("band").cast("long"), bits).bitwiseOR(F.col("value").cast("long")).alias("shard"))
    near = components(simhash.stars(simhash.searched(shards, RADIUS)))
    kinds = made.groupBy("node").agg(F.min(key).alias(key), F.min("fp").alias("fp"))
    kinds = written(kinds.join(near.select(F.col("node").alias("_fp"), F.col("root").alias("band")), F.col("fp") == F.col("_fp"), "left").select("node", key, F.coalesce("band", "fp").alias("band")))
    shared = kinds.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("long")
    places = written(kinds.join(shared, "band").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("n"))
    texts = keyset.Keys(places, key).within(docs.select(key, "text")).join(places, key).dropDuplicates([key])
    sets = texts.select("node", "band", "part", "parts", _packed("text").alias("own"))
    units = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("a"), F.greatest("part", q).alias("b")))
    rows = sets.select("node", "band", "part", "own", F.explode(units).alias("u")).select("node", "band", "u.a", "u.b", "part", "own")
    found = rows.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b").mapInPandas(_compared, "u binary, v binary")
    roots = components(found)
    return made.join(roots, made["node"] == roots["node"], "left").select("doc_id", key, F.coalesce("root", made["node"]).alias("root"))
