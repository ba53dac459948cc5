import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from prefixloom.llm import simhash
from prefixloom.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp); every pair is looked at."""
    root = {fp: fp for _, fp in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, fp in rows:
        if d is not None:
            least[find(fp)] = min(d, least.get(find(fp), d))
    return {(d, fp): least.get(find(fp)) for d, fp in rows}


def test_prints_and_components_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"Wort{i}" for i in range(300)]
    texts = [None, "", " \n ", "one", "One two", "ÀB c", "a b c d"]
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("\t".join(near))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[20]), (5, texts[20]), (None, texts[30]), (None, "alone here and now")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = [(d, brute_print(t)) for d, t in rows]
    of = brute_components(want)
    assert sorted(got, key=str) == sorted([(d, fp, of[d, fp]) for d, fp in want], key=str)
    assert len({c for *_, c in got}) < len({fp for _, fp, _ in got})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i * 7919 % 1013) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 37)
    assert simhash.fingerprint(text) == whole == brute_print(text)


@pytest.mark.parametrize(("shard", "levels"), [(20_000, 3), (100, 3), (7, 3), (7, 2)])
def test_dense_and_cut_shards(spark, shard, levels, monkeypatch):
    """Groups of prints a few bits apart, far more in a shard than one may hold."""
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = random.Random(2)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame, shard=shard)).collect()}
    got, want = {}, {}
    of = brute_components(list(enumerate(fps)))
    for i, (x, s) in enumerate(zip(fps, signed)):
        got.setdefault(found.get(s, s), set()).add(x)
        want.setdefault(of[i, x], set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_forest_batches_of_one(spark):
    """Trees that come in pieces are searched whole."""
    import pandas as pd

    rng = random.Random(3)
    rows = []
    for shard in range(5):
        centre = rng.getrandbits(62)
        nodes = {centre ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(12)}
        rows += [(shard, fp) for fp in sorted(nodes)]
    frame = pd.DataFrame(rows, columns=["shard", "fp"])
    edges = {tuple(sorted(e)) for part in simhash._search_sorted((frame.iloc[[i]] for i in range(len(frame))), 3) for e in part.itertuples(index=False)}
    ids = [(i, r[1]) for i, r in enumerate(rows)]
    of = brute_components(ids)
    root = {fp: fp for _, fp in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert (int(a) ^ int(b)).bit_count() <= 3
        root[find(a)] = find(b)
    assert len({find(fp) for _, fp in ids}) == len(set(of.values()))


def test_hot_shard_of_far_prints(spark):
    """Half of the prints agree on 16 bits, as in a shard of a very large table."""
    rng = random.Random(4)
    fps = {rng.getrandbits(48) << 16 | 0xBEEF for _ in range(1500)} | {rng.getrandbits(64) for _ in range(1000)}
    fps |= {fp ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for fp in rng.sample(sorted(fps), 400)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {tuple(sorted((r.u & (1 << 64) - 1, r.v & (1 << 64) - 1))) for r in simhash.links(frame, shard=50).collect()}
    fps = np.array(sorted(fps), np.uint64)
    want = set()
    for i in range(len(fps) - 1):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            want.add((int(fps[i]), int(fps[j])))
    assert got == want or got < want and len({x for e in got for x in e}) == len({x for e in want for x in e})
    assert len(got) >= 390


def test_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7)], "doc_id long, text string, n int")
    assert simhash.near_duplicates(docs, carry=("n",)).first().n == 7
    with pytest.raises(ValueError, match="carry"):
        simhash.near_duplicates(docs.withColumnRenamed("n", "Root"), carry=("Root",))


@pytest.mark.parametrize("words", [1, 3])
def test_a_shard_gives_a_forest_of_links(words):
    """A group whose prints are mostly linked beside the tree, not by its edges: fewer links than prints, and they join all that are near."""
    rng = np.random.default_rng(8)
    noise = np.packbits(rng.random((300, words * 64)) < 0.17, axis=1, bitorder="little").view(np.uint64)
    fp = np.unique(rng.integers(0, 1 << 63, (1, words), np.uint64) ^ noise, axis=0)
    fp = fp if words > 1 else fp[:, 0]
    radius = 20 * words - 2
    links = simhash._searched(np.zeros(len(fp), np.int64), fp, radius)
    names = {(x.tobytes() if words > 1 else x.view(np.int64)): i for i, x in enumerate(fp)}
    near = [(i, j) for i in range(len(fp)) for j in range(i) if simhash._apart(fp[i : i + 1], fp[j : j + 1])[0] <= radius]

    def joined(pairs):
        root = list(range(len(fp)))
        for i, j in pairs:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
        return root

    got = [(names[u], names[v]) for u, v in zip(links["u"], links["v"])]
    assert joined(got) == joined(near) and len(near) > 10 * len(fp)
    assert len(got) == len(fp) - len(set(joined(near)))


def test_stars_of_shards_name_the_same_pairs():
    """Forests of many shards over one group have many different links, the stars of tasks few, with the same components."""
    rng = np.random.default_rng(9)
    fps = np.array([c ^ np.packbits(rng.random(192) < 0.05).view(np.uint64) for c in rng.integers(0, 1 << 63, (3, 3), np.uint64) for _ in range(200)])
    forests, stars = set(), set()
    for _ in range(5):
        shards = [rng.random(len(fps)) < 0.3 for _ in range(12)]
        links = [simhash._searched(np.zeros(own.sum(), np.int64), fps[own], 58) for own in shards]
        (star,) = simhash._star_batches(iter([links[0].iloc[:0], *links]))
        assert len(star) <= 597
        forests |= {p for x in links for p in zip(x["u"], x["v"])}
        stars |= set(zip(star["u"], star["v"]))

    def joined(pairs):
        root = {fp.tobytes(): fp.tobytes() for fp in fps}
        for u, v in pairs:
            low, high = sorted((root[u], root[v]))
            root = {k: low if r == high else r for k, r in root.items()}
        return root

    assert joined(forests) == joined(stars) and len(set(joined(stars).values())) == 3
    assert len(forests) > 2 * len(stars)


def test_stars_are_held_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 3)
    name = [bytes([9 - i]) * 24 for i in range(10)]
    batch = pd.DataFrame({"u": name[:-1], "v": name[1:]})
    got = list(simhash._star_batches(iter([batch.iloc[:0], batch.iloc[:2], batch.iloc[2:4], batch.iloc[4:]])))
    assert [[(u, v) for u, v in zip(f["u"], f["v"])] for f in got] == [[(name[i], name[4]) for i in (3, 2, 1, 0)], [(name[i], name[9]) for i in (8, 7, 6, 5, 4)]]


def test_stars_of_tasks_do_not_multiply_links(spark):
    """Tasks that each hold some of a group have different least prints; a group's links are few all the same, in however many tasks it is."""
    rng = random.Random(10)
    prints = [[bytes([g]) + rng.randbytes(23) for _ in range(300)] for g in (1, 2)]
    tasks = [[rng.sample(group, 60) for group in prints] for _ in range(40)]
    rows = [[(a, b) for own in task for a, b in zip(own, own[1:])] for task in tasks]
    links = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)).flatMap(lambda x: x), "u binary, v binary")
    assert links.rdd.getNumPartitions() == 40 and links.count() == 40 * 2 * 59
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(bytes(r.u), bytes(r.v)) for r in simhash.stars(links).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    joined = spark.createDataFrame([(bytearray(u), bytearray(v)) for u, v in got], "u binary, v binary")
    roots = {bytes(r.node): bytes(r.root) for r in components(joined).collect()}
    shared = [{x for task in tasks for x in task[g]} for g in (0, 1)]
    assert roots == {x: min(own) for own in shared for x in own if x != min(own)}
    assert len(got) < 1.2 * len(roots)
