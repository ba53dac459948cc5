"""Near copies by Jaccard similarity against a comparison of every pair."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from prefixloom.llm import jaccard, simhash

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    """The least position of each text's group; every pair is compared."""
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(rng, base, edits):
    near = list(base)
    for _ in range(edits):
        near[rng.randrange(len(near))] = f"neu{rng.random()}"
    return " ".join(near)


@pytest.mark.parametrize("part", [500, 3])
def test_groups_match_every_pair(spark, part):
    rng = random.Random(5)
    texts = [None, "", " \n", "One two", "one  TWO", "three"]
    for _ in range(25):
        base = rng.choices([f"wort{i}" for i in range(400)], k=rng.randint(30, 300))
        texts += [edited(rng, base, rng.randint(0, 6)) for _ in range(rng.randint(1, 9))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3)], "doc_id long, text string, k long")
    got = jaccard.near_copies(docs, "k", part).collect()
    least = {}
    for r in got:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert len(got) == len(docs.collect())
    assert {r.doc_id: least[r.root] for r in got} == dict(enumerate(brute_groups(texts)))
    assert not jaccard.near_copies(docs.where("false"), "k").count()


def test_stage_keeps_no_edited_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = brute_groups([t for _, t in rows])
    want = [d for k, (d, _) in enumerate(rows) if groups[k] == k]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == want


def wide_print(text, words):
    """Bits of the wide print, counted one by one."""
    h = sorted({xxhash.xxh64_intdigest(b" ".join(s), 42) for s in brute_shingles(text)})
    bits = []
    for w in range(words):
        mixed = []
        for x in h:
            if w:
                x = (x + 0x9E3779B97F4A7C15 * w) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
            mixed.append(x)
        bits += [2 * sum(x >> b & 1 for x in mixed) > len(h) for b in range(64)]
    return bits


@pytest.mark.parametrize("n", [1, 4, 7, 254, 600])
def test_wide_prints(n):
    text = " ".join(f"w{i}" for i in range(n + 4))
    own = jaccard.shingles(text)
    bits = wide_print(text, 12)
    assert len(own) == n and simhash.wide(own, 12).tolist() == bits
    fp, bands = jaccard.signed(own, 6)
    assert fp == np.packbits(bits[:192], bitorder="little").tobytes()
    assert [[bool(v >> i & 1) for i in range(6)] for v in bands[:30].tolist()] == [bits[6 * t : 6 * t + 6] for t in range(min(30, len(bands)))]
    assert n < 4 and not len(bands) or all((1 - (1 - r) ** 6) ** len(bands) <= jaccard.MISSED for most, r in jaccard.RATES if n <= most)


@pytest.mark.parametrize("shards", [1, 3])
def test_trees_of_wide_prints(spark, shards):
    """Links of BK-trees join what a comparison of every pair joins; repeated prints are one node."""
    rng = np.random.default_rng(6)
    fps = [c ^ np.packbits(rng.random(192) < share).view(np.uint64) for c in rng.integers(0, 1 << 63, (6, 3), np.uint64) for share in rng.random(30) * 0.25]
    rows = [(i % shards, fp.tobytes()) for i, fp in enumerate(fps)]
    found = simhash.searched(spark.createDataFrame([(s, bytearray(b)) for s, b in rows + rows[:40]], "shard long, fp binary"), jaccard.RADIUS).collect()

    def groups(pairs):
        root = {b: b for _, b in rows}
        for u, v in pairs:
            low, high = sorted((root[u], root[v]))
            root = {k: low if r == high else r for k, r in root.items()}
        return root

    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    near = [(a, b) for i, (s, a) in enumerate(rows) for t, b in rows[:i] if s == t and far(a, b) <= jaccard.RADIUS]
    got = [(bytes(r.u), bytes(r.v)) for r in found]
    assert groups(got) == groups(near) and all(0 < far(u, v) <= jaccard.RADIUS for u, v in got)
    assert 1 < len(set(groups(got).values())) < len(fps)


def test_candidates_come_from_prints_and_trees(spark, monkeypatch):
    """Pairs at 0.8 to 0.83, short ones (4 and 5 shingles) too, are all found, and by operator 1's BK-trees alone."""
    rng, texts = random.Random(7), []
    for i in range(400):
        words = [f"{i}_{j}" for j in range(rng.choice([9, 16, 24, 54, 204, 404]))]
        n = len(words) - 4
        texts += [" ".join(words), " ".join(words[: len(words) - int(0.2 * n)])]  # a part of at least 0.8
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k long")
    groups = lambda: len({bytes(r.root) for r in jaccard.near_copies(docs, "k").collect()})
    assert groups() == 400
    held = simhash.searched
    monkeypatch.setattr(simhash, "searched", lambda rows, radius: held(rows, radius).where("false"))
    assert groups() == 800


def test_links_of_a_cut_group_do_not_grow_with_its_pairs_of_parts():
    """Two parts whose sets are all near are joined by one link; each part's own unit joins it within."""
    base = np.arange(100, dtype=np.uint64)
    sets = [np.append(base, np.uint64(1000 + i)) for i in range(20)] + [np.append(base + np.uint64(5000), np.uint64(9000 + i)) for i in range(4)]
    part = np.arange(24) % 2
    cross = jaccard.linked(sets, part)
    assert len(cross) == 2 and all(part[i] != part[j] for i, j in cross)
    assert len(jaccard.linked(sets)) == 22
    assert jaccard.linked(sets, np.arange(24)) and len(jaccard.linked(sets, np.arange(24))) == 22
