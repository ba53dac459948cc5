"""SimHash near-dedup with BK-trees (operator 1).

Every text gets a 64-bit fingerprint of its word shingles' XXH64. Fingerprints within ``RADIUS`` bits
are linked, links form components, a component's id is its least doc_id.

Links are found between different fingerprints only (copies share one). They are dealt into shards:
of RADIUS + 1 bands of bits at least one is equal in any two fingerprints within the radius, so a
shard is a band and its value. Each shard has a BK-tree (children keyed by integer Hamming distance
to the parent), and a search follows only edges within the radius of the distance at hand. Trees of
many shards are built and searched at once as arrays. A tree edge within the radius is itself a link;
subtrees that such edges, or links found since, already join to the searching node are left out, so a dense
group of near copies costs no quadratic work. A shard gives a forest of links, fewer than its nodes.

The trees are not broadcast: together they hold every fingerprint, which has no proven bound. They go
to tasks by shuffle. A shard of more than ``SHARD`` fingerprints is dealt again by bands of the bits that it
doesn't share (of these, too, one band at least is equal within the radius), up to ``LEVELS`` times: four
rows for one, however large the shard is, and links come out the same. At 10 ** 10 fingerprints the
first bands hold some 150,000 each and the second some 40.

Wider prints, for a larger radius, are arrays of words (binary in a table): ``wide`` makes their bits and
``searched`` links what is dealt into shards by the caller (``jaccard``, the pipeline's stage).

Defined results: null, empty and blank texts have fingerprint 0 and are linked like others; a null
doc_id is skipped as a component's id (a component of null ids alone has a null id); very long texts are
read whole, in pieces; repeated rows each give a row; an empty table gives an empty result; other columns
than ``carry`` are dropped, and ``carry`` must not name a column of the result (an error).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import written
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
SHARD = 20_000
#: Times that fingerprints are dealt by bands: 16 bits, then 12 of the other 48, then 9 of the other 36.
LEVELS = 3
#: Pairs of a search held at once.
FRONTIER = 1 << 20
#: Links held at once to make stars of them.
HELD = 1 << 17
_PIECE = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _PIECE], ends[at : at + _PIECE])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits of a print of ``words`` times 64 bits, by majority as in ``fingerprint``; of a hash, the first word is itself and others are mixed from it."""
    ones, step = np.zeros(64 * words, np.int64), _STEP * np.arange(words, dtype=np.uint64)
    for at in range(0, len(hashes), 255):  # sums stay within a byte
        h = hashes[at : at + 255, None] + step
        h[:, 1:] = _mixed(h[:, 1:])
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        h = (h ^ (h >> shift)) * factor
    return h ^ (h >> np.uint64(31))


@pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; prints of several words are rows."""
    if a.ndim == 1:
        return np.bitwise_count(a ^ b).astype(np.int64)
    return sum(np.bitwise_count(a[:, i] ^ b[:, i]).astype(np.int64) for i in range(a.shape[1]))


class Forest:
    """BK-trees over the fingerprints of several shards: ``shard`` and ``fp`` sorted by shard, none twice in a shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray, radius: int):
        n = len(fp)
        self.fp, self.radius, self.bits = fp, radius, 64 * (fp.shape[1] if fp.ndim > 1 else 1)
        base = self.bits + 1
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.roots = np.flatnonzero(first)
        self.root_of = self.roots[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        active, at, levels = np.flatnonzero(~first), self.root_of[~first], []
        while len(active):
            d = _apart(fp[active], fp[at])
            _, chosen, which = np.unique(at * base + d, return_index=True, return_inverse=True)
            new = active[chosen]
            parent[new], edge[new] = at[chosen], d[chosen]
            levels.append(new)
            rest = np.ones(len(active), bool)
            rest[chosen] = False
            active, at = active[rest], new[which[rest]]
        #: A child comes after its parent.
        self.rank = np.zeros(n, np.int64)
        self.rank[np.concatenate([self.roots, *levels])] = np.arange(n)
        self.comp = np.arange(n)
        for lv in levels:
            near = lv[edge[lv] <= radius]
            self.comp[near] = self.comp[parent[near]]
        # one: the component of a whole subtree, -1 if it has several
        self.one = self.comp.copy()
        for lv in reversed(levels):
            other = lv[self.one[lv] != self.comp[parent[lv]]]
            self.one[parent[other]] = -1
        below = np.flatnonzero(parent >= 0)
        key = parent[below] * base + edge[below]
        order = np.argsort(key, kind="stable")
        self.keys, self.children = key[order], below[order]
        self.inner = np.zeros(n, bool)
        self.inner[parent[below]] = True
        linked = below[edge[below] <= radius]
        self.links = fp[linked], fp[parent[linked]]

    def search(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of every node to nodes of a lower rank, those that join components: fewer than there are nodes, however many pairs are near."""
        fp, comp, one = self.fp, self.comp, self.one
        found_q, found_n, base = [], [], self.bits + 1
        stack = [(np.arange(len(fp)), self.root_of)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            if not len(q):
                continue
            d = _apart(fp[q], fp[node])
            hit = np.flatnonzero((d <= self.radius) & (d > 0) & (comp[node] != comp[q]))
            if len(hit):
                kept, label = spanning(comp[q[hit]], comp[node[hit]], len(fp))
                found_q.append(q[hit[kept]])
                found_n.append(node[hit[kept]])
                comp, one = label[comp], np.where(one < 0, one, label[one])
            inner = self.inner[node]
            q, node, d = q[inner], node[inner], d[inner]
            lo = np.searchsorted(self.keys, node * base + np.maximum(d - self.radius, 1))
            count = np.searchsorted(self.keys, node * base + np.minimum(d + self.radius, self.bits), "right") - lo
            q = np.repeat(q, count)
            node = self.children[np.arange(len(q)) + np.repeat(lo - (np.cumsum(count) - count), count)]
            go = (one[node] != comp[q]) & (self.rank[node] < self.rank[q])
            stack.append((q[go], node[go]))
        if not found_q:
            return fp[:0], fp[:0]
        return fp[np.concatenate(found_q)], fp[np.concatenate(found_n)]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between labels below ``n``, the indexes of a spanning forest; the label that each label gets."""
    label, at, kept = np.arange(n), np.arange(len(a)), []
    while len(at):
        x, y = label[a[at]], label[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        top, first = np.unique(high[order], return_index=True)
        first = order[first]
        kept.append(at[first])
        lower = np.arange(n)  # links go down only, so they make no circle
        lower[top] = low[first]
        while not np.array_equal(deeper := lower[lower], lower):
            lower = deeper
        label = lower[label]
    return np.concatenate(kept) if kept else at, label


def _searched(shard: np.ndarray, fp: np.ndarray, radius: int) -> pd.DataFrame:
    """Links in whole shards, sorted by shard; wide prints may be repeated side by side."""
    if fp.ndim > 1:
        new = np.ones(len(fp), bool)
        new[1:] = (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1]).any(1)
        shard, fp = shard[new], fp[new]
    forest = Forest(shard, fp, radius)
    parts = forest.links, forest.search()
    u, v = (np.concatenate(x) for x in zip(*parts))
    if fp.ndim > 1:
        return pd.DataFrame({"u": [x.tobytes() for x in u], "v": [x.tobytes() for x in v]}, dtype=object)
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def _search_sorted(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows (shard, fp), sorted by shard; holds a batch and one shard: what there is of the last shard waits for the next batch."""
    shards, fps = [], []
    for batch in batches:
        if not len(batch):
            continue
        shard, fp = batch["shard"].to_numpy(), batch["fp"]
        fp = fp.to_numpy().view(np.uint64) if fp.dtype != object else np.frombuffer(b"".join(fp), np.uint64).reshape(len(fp), -1)
        last = np.searchsorted(shard, shard[-1])
        if last or shards and shards[-1][-1] != shard[0]:
            yield _searched(np.concatenate([*shards, shard[:last]]), np.concatenate([*fps, fp[:last]]), radius)
            shards, fps = [], []
        shards.append(shard[last:])
        fps.append(fp[last:])
    if shards:
        yield _searched(np.concatenate(shards), np.concatenate(fps), radius)


def _dealt(rows: DataFrame, width: int, bands: int) -> DataFrame:
    """Rows (fp, shard, rest) by band of the ``width`` low bits of ``rest``: the shard takes in the band's value, the rest loses it."""
    each = width // bands

    def one(i: int) -> Column:
        low, size = i * each, each if i < bands - 1 else width - each * (bands - 1)
        value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", low + size), low) if low + size < 64 else F.lit(0).cast("long")
        # Different shards that hash alike would only share a tree.
        return F.struct(F.xxhash64("shard", F.lit(i), value).alias("shard"), below.bitwiseOR(above).alias("rest"))

    return rows.select("fp", F.explode(F.array(*[one(i) for i in range(bands)])).alias("to")).select("fp", "to.shard", "to.rest")


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v) of the different fingerprints ``fp``, enough to join all that are within ``radius`` bits."""
    bands, width = radius + 1, 64
    rows, ready = prints.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest")), None
    for level in range(LEVELS):
        rows = _dealt(rows, width, bands)
        width -= width // bands
        if level == LEVELS - 1 or width // bands < 2:
            break
        large = written(rows.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") > shard).select(F.col("shard").alias("_large")))
        if large.isEmpty():
            break
        # Whole shards stay; what a large one holds is dealt once more, by the bits that are left.
        small = rows.join(large, F.col("shard") == F.col("_large"), "left_anti").select("shard", "fp")
        ready = small if ready is None else ready.unionByName(small)
        rows = rows.join(large, F.col("shard") == F.col("_large"), "left_semi")
    rows = rows.select("shard", "fp")
    rows = rows if ready is None else ready.unionByName(rows)
    return searched(rows, radius)


def searched(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of the prints in each shard of ``rows`` (shard, fp): fp long, or binary if wide; a wide one may be repeated in its shard."""
    kind = rows.schema["fp"].dataType.simpleString().replace("bigint", "long")
    order = ["shard"] if kind == "long" else ["shard", "fp"]
    return rows.repartition("shard").sortWithinPartitions(*order).mapInPandas(lambda batches: _search_sorted(batches, radius), f"u {kind}, v {kind}")


def _star_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of ``HELD`` links and a batch at a time."""

    def made(frames: list[pd.DataFrame]) -> pd.DataFrame:
        ends = [b for end in ("u", "v") for f in frames for b in f[end]]
        rows = np.frombuffer(b"".join(ends), np.uint64).reshape(len(ends), -1)
        _, first, at = np.unique(rows.view(f"S{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        label = spanning(*at.reshape(2, -1), len(first))[1]
        other = np.flatnonzero(label != np.arange(len(first)))
        return pd.DataFrame({"u": [ends[i] for i in first[other]], "v": [ends[i] for i in first[label[other]]]}, dtype=object)

    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            rows += len(batch)
        if rows >= HELD:
            yield made(held)
            held, rows = [], 0
    if held:
        yield made(held)


def stars(links: DataFrame) -> DataFrame:
    """For links (u, v) of wide prints, links with the same components: each print with the least that the links at hand join it to.

    Each shard has its own forest over a group of near copies, with other links. Dealt by print, they become stars, of which each task has
    its own least print; dealt so once more, a print's links join the least prints of those tasks, and most stars have the same one. When
    repeated links are dropped, little more than one is left for each print, in however many shards and tasks it was. The stars have
    stages of their own: a Python worker beside the search's would double an executor's workers.
    """
    for _ in range(2):
        links = links.repartition("u").sortWithinPartitions("u", "v").mapInPandas(_star_batches, "u binary, v binary")
    return links


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fp (long), component_id and root (the component's least fingerprint) of every row of ``docs``, and the columns ``carry``."""
    if clash := {c.lower() for c in carry} & {"doc_id", "fp", "component_id", "root"}:
        raise ValueError(f"carry names columns of the result: {sorted(clash)}")
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), *carry, fingerprints(F.col(text)).alias("fp")))
    by_print = written(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    roots = components(links(by_print.select("fp"), radius, shard))
    rooted = by_print.join(roots, by_print["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("_least").alias("component_id"))
    by_print_id = rooted.join(least, rooted["root"] == least["_r"]).select(F.col("fp").alias("_fp"), "component_id", "root")
    return prints.join(by_print_id, prints["fp"] == by_print_id["_fp"], "left").select("doc_id", *carry, "fp", "component_id", "root")
