"""SimHash links and components against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from txrisk.llm import simhash_trees as S

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    """Least index reachable, by comparing all pairs."""
    fps = np.array(fps, np.uint64)
    name = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        low = np.where(near, name[None, :], len(fps)).min(axis=1)
        if (low == name).all():
            return name
        name = low


def families(rnd, n):
    out = []
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 5, 40])):
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                y ^= 1 << b
            out.append(y)
            if rnd.random() < 0.3:
                x = y
    return sorted(set(out[:n]))


def merge(n, links):
    name = list(range(n))
    def root(i):
        while name[i] != i:
            i = name[i]
        return i
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        name[b] = a
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("bits", [64, 20])
def test_trees_lose_no_link(bits):
    """Routing over many small shards, a crowded space, and small leaves."""
    rnd = random.Random(bits)
    fps = np.array(sorted({x & ((1 << bits) - 1) for x in families(rnd, 1500)}), np.uint64)
    at = {int(x): i for i, x in enumerate(fps)}
    forest = S.Forest.fit(fps[::3], len(fps), 4, shard=100)
    assert len(forest.blocks) > 8
    tree = np.repeat(S._trees(forest), forest.blocks)
    shard, visit, x = forest.route(fps)
    homes = Counter(zip(x[~visit].tolist(), tree[shard[~visit]].tolist()))
    assert len(homes) == 4 * len(fps) and set(homes.values()) == {1}  # one home in each tree
    links = []
    for s in np.unique(shard).tolist():
        here = shard == s
        for part in S.links_within(np.unique(x[here & ~visit]), x[here & visit], S.part_masks(int(tree[s]), 4), 4, leaf=16):
            links += part.tolist()
    assert merge(len(fps), [(at[a], at[b]) for a, b in links]) == plain_components(fps).tolist()


def test_dense_leaf_gives_no_pairs():
    rnd = random.Random(3)
    x = rnd.getrandbits(64)
    dense = np.array(sorted({x ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64)
    n = sum(len(p) for p in S.links_within(dense, dense[:0], S.part_masks(0, 4), 4))
    assert len(dense) > 2000 and n < 60 * len(dense)


def test_fingerprints():
    rnd = random.Random(4)
    vocab = ["Ab", "cd", "É", "x", "日本", "longer-word"]
    for n in (0, 1, 2, 3, 4, 5, 50):
        t = "".join(rnd.choice(vocab) + rnd.choice([" ", "\t", "\n\x0b ", " "]) for _ in range(n))
        assert S.fingerprint(t.encode()) == plain_fingerprint(t)
    long = " ".join(rnd.choice(vocab) for _ in range(70_000))
    assert S.fingerprint(long.encode()) == plain_fingerprint(long)


def expected(rows):
    ids, fps = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    name, same, low = plain_components(fps), Counter(fps), {}
    for i, c in zip(ids, name.tolist()):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    return sorted(((i, f"{f:016x}", low.get(c), same[f]) for i, f, c in zip(ids, fps, name.tolist())), key=repr)


def test_query_against_all_pairs(spark):
    from txrisk.llm.queries import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries()["op12_simhash_near_duplicates"](spark, SF).collect()), key=repr)
    want = expected(rows)
    assert got == want
    assert len({r[2] for r in want}) < len(rows) - 5


def test_edges_and_small_shards(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "a " * 50_000)]
    for i in range(10, 120):
        words = list(base) if i % 3 else [f"v{rnd.randint(0, 500)}" for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(len(words))] = "x"
        rows.append((i, " ".join(words)))
    rows += [rows[20], rows[20], (None, rows[21][1]), (None, "only of a null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("fp", "n", "low", "c", "k", "hot_n", "fingerprint", "component_id"):
        df = df.withColumn(c, F.lit("x"))
    want = expected(rows)
    for sizes in ({}, {"shard": 8, "sample": 40, "leaf": 4}):
        got = sorted((tuple(r) for r in S.simhash_components(df.repartition(3), **sizes).collect()), key=repr)
        assert got == want
    assert S.simhash_components(df.limit(0)).count() == 0
