"""Operator 12: SimHash near-duplicates through vantage-point trees.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word
shingles.  Fingerprints at most ``radius`` bits apart are linked.

Equal fingerprints are grouped first.  The rest is found with one
vantage-point tree for each of ``PARTS`` 16-bit parts: two fingerprints that
differ in r bits differ in at most r / PARTS bits of some part.  A node holds a
vantage fingerprint, a mask (the part, or all bits) and a distance; those
within it go left, the others right.  By the triangle inequality a fingerprint
can only have a partner across the border if its own distance to the vantage
is within the radius of it, so only such ones of the left side also *visit* the
right side; visitors go on to either side that their ball reaches.

The upper part of each tree is fitted on at most ``SAMPLE`` fingerprints and
sent to all tasks; its leaves are shards.  Every fingerprint goes to its home
shard and visits those its ball overlaps.  A task streams its shards: the home
fingerprints are held (their number is bounded by the fit, and crowded leaves
that no vantage can split are cut in blocks), visitors pass in chunks.  Within a
shard the same tree is carried on to small leaves, where whole fingerprints are
compared.  A leaf gives links to one member of each component it knows, not
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.components import connected_components
from txrisk.llm.spark_io import materialize, sized, text_slices
from txrisk.llm.words import mix

RADIUS = 4
WIDTH = 4
SEED = 42
PARTS = 4
SAMPLE = 1 << 16       # fingerprints the trees are fitted on
SHARD = 16_384         # home fingerprints a shard should hold
LEAF = 256             # fingerprints compared without further splits
CHUNK = 1 << 17        # visitors held at once
SHINGLES = 1 << 16     # hashes whose bits are counted at once
HOT_SHARE = 1 / 2048
ALL = np.uint64(2**64 - 1)


# ---- fingerprints -------------------------------------------------------------------------------

def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Majority bits of the XXH64 of all shingles (repeats count); no word gives 0."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and cut at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end + 1 - size)[:max(1, len(words) - width + 1)].tolist()
    end = end[min(width, len(words)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(start), SHINGLES):
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in
                         zip(start[k:k + SHINGLES], end[k:k + SHINGLES])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in text_slices(batches):
            raw, off = buf.tobytes(), off.tolist()
            fp = np.array([fingerprint(raw[a:b], width) for a, b in zip(off[:-1], off[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---- trees --------------------------------------------------------------------------------------

def distance(x: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ vantage) & mask).astype(np.int64)


@dataclass(frozen=True)
class Split:
    vantage: np.uint64
    mask: np.uint64
    reach: int    # radius in the bits of the mask
    border: int   # distances up to it are on the left

    def sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At home on the left; ball reaches the left; ball reaches the right."""
        d = distance(x, self.vantage, self.mask)
        return d <= self.border, d - self.reach <= self.border, d + self.reach > self.border


def best_split(x: np.ndarray, masks: list[tuple[np.uint64, int]]) -> Split | None:
    """Of a few vantages from ``x`` and the distances near the median, the split whose border
    fewest balls overlap; None if each leaves one side empty."""
    best, least = None, np.inf
    look = x if len(x) <= 4096 else x[::len(x) // 4096 + 1]
    for k in range(3):
        v = look[(2 * k + 1) * len(look) // 6]
        for mask, reach in masks:
            d = distance(look, v, mask)
            mid = int(np.median(d))
            for border in (mid - 1, mid):
                left = int((d <= border).sum())
                if 0 < left < len(d):
                    both = int(((d - reach <= border) & (d + reach > border)).sum())
                    score = (both / len(d)) + abs(left / len(d) - 0.5)
                    if score < least:
                        best, least = Split(v, mask, reach, border), score
    return best


def part_masks(part: int, radius: int, parts: int = PARTS) -> list[tuple[np.uint64, int]]:
    bits = 64 // parts
    return [(np.uint64(((1 << bits) - 1) << (bits * part)), radius // parts), (ALL, radius)]


@dataclass
class Forest:
    """The upper trees.  ``nodes`` of a tree: a Split with its two children, or a leaf."""
    roots: list = field(default_factory=list)
    blocks: list = field(default_factory=list)  # blocks of each leaf
    first: list = field(default_factory=list)   # number of a leaf's first shard

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, radius: int, shard: int = SHARD, parts: int = PARTS) -> Forest:
        f = cls()
        fair = max(16.0, shard * len(sample) / max(total, 1))  # sampled ones in a full shard
        for part in range(parts):
            f.roots.append(f._grow(sample, part_masks(part, radius, parts), fair))
        f.first = (np.cumsum(f.blocks) - f.blocks).tolist()
        return f

    def _grow(self, x: np.ndarray, masks: list, fair: float):
        split = best_split(x, masks) if len(x) > fair else None
        if split is None:
            self.blocks.append(max(1, int(np.ceil(len(x) / fair / 2))))
            return len(self.blocks) - 1
        home = split.sides(x)[0]
        return split, self._grow(x[home], masks, fair), self._grow(x[~home], masks, fair)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, visiting, fingerprint) of all homes and visits of ``x``."""
        shard, visit, fp = [], [], []

        def put(leaf: int, rows: np.ndarray, block: np.ndarray, visiting: bool) -> None:
            shard.append(self.first[leaf] + block)
            visit.append(np.full(len(rows), visiting))
            fp.append(rows)

        def go(node, home: np.ndarray, guest: np.ndarray) -> None:
            if len(home) + len(guest) == 0:
                return
            if isinstance(node, tuple):
                split, left, right = node
                own, _, far = split.sides(home)
                _, near, over = split.sides(guest)
                go(left, home[own], guest[near])
                go(right, home[~own], np.concatenate([guest[over], home[own & far]]))
                return
            n = self.blocks[node]
            own = (mix(home) % np.uint64(n)).astype(np.int64)
            put(node, home, own, False)
            for b in range(n):  # a block's members meet those of the blocks after it
                put(node, np.concatenate([guest, home[own < b]]),
                    np.full(len(guest) + int((own < b).sum()), b), True)

        for root in self.roots:
            go(root, x, x[:0])
        return np.concatenate(shard), np.concatenate(visit), np.concatenate(fp)


def leaf_links(home: np.ndarray, guest: np.ndarray, among: bool, radius: int) -> Iterator[np.ndarray]:
    """Links (k, 2) that connect what is linked among ``home`` and from ``guest`` to it."""
    name = np.arange(len(home))
    if len(home) > 1:
        near = np.bitwise_count(home[:, None] ^ home[None, :]) <= radius
        while True:  # least reachable position
            low = np.where(near, name[None, :], len(home)).min(axis=1)
            low = low[low]
            if (low == name).all():
                break
            name = low
        if among:
            # a member's link to its least neighbour, until the component's least one: a spanning set
            i, j = np.nonzero(near & (np.arange(len(home))[:, None] > np.arange(len(home))[None, :]))
            if len(i) > 2 * len(home):
                i, j = np.arange(len(home)), name
                i, j = i[i != j], j[i != j]
            yield np.stack([home[i], home[j]], axis=1)
    for k in range(0, len(guest), 8192):
        g = guest[k:k + 8192]
        a, b = np.nonzero(np.bitwise_count(g[:, None] ^ home[None, :]) <= radius)
        if len(a):
            key = np.unique(a * len(home) + name[b])  # one link per guest and component
            yield np.stack([g[key // len(home)], home[key % len(home)]], axis=1)


def links_within(home: np.ndarray, guest: np.ndarray, masks: list, radius: int, among: bool = True,
                 leaf: int = LEAF) -> Iterator[np.ndarray]:
    """Links among ``home`` (if ``among``) and between it and ``guest``, as far as the tree
    with these masks finds them, and by components of small leaves."""
    stack = [(home, guest, among)]
    while stack:
        home, guest, among = stack.pop()
        if len(home) == 0 or (len(guest) == 0 and not among):
            continue
        split = best_split(home, masks) if len(home) > leaf else None
        if split is not None:
            own, _, far = split.sides(home)
            _, near, over = split.sides(guest)
            stack.append((home[own], guest[near], among))
            cross = np.concatenate([guest[over], home[own & far]]) if among else guest[over]
            stack.append((home[~own], cross, among))
            continue
        for k in range(0, len(home), 4 * leaf):  # more than a leaf only where nothing splits
            part = home[k:k + 4 * leaf]
            yield from leaf_links(part, np.concatenate([guest, home[:k]]) if among else guest, among, radius)


def near_links(fps: DataFrame, total: int, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE,
               leaf: int = LEAF) -> DataFrame:
    """a, b: links of different fingerprints (column fp, ``total`` distinct ones) at most
    ``radius`` bits apart; all linked ones are connected through them."""
    # by hash: about ``sample`` fingerprints, the same ones whatever the partitions
    some = fps if total <= sample else fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < (sample << 40) // total)
    some = some.select("fp").toArrow().column("fp").to_numpy().view(np.uint64)
    forest = Forest.fit(some[np.argsort(mix(some))], total, radius, shard)
    shards, tree = sum(forest.blocks), np.repeat(_trees(forest), forest.blocks)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            s, v, x = forest.route(batch.column("fp").to_numpy().view(np.uint64))
            for k in range(0, len(s), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[k:k + (1 << 16)].astype(np.int32)), pa.array(v[k:k + (1 << 16)]),
                     pa.array(x[k:k + (1 << 16)].view(np.int64))], ["shard", "visiting", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, home, guests in _shards(batches):
            masks, among = part_masks(int(tree[number]), radius), True
            home = np.unique(home)
            for guest in guests:
                found = list(links_within(home, np.unique(guest), masks, radius, among, leaf))
                among = False
                if found:
                    ab = np.unique(np.concatenate(found).view(np.int64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    n = max(1, min(shards, max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 8)))
    return (fps.select("fp").mapInArrow(route, "shard int, visiting boolean, fp long")
            .repartition(n, "shard").sortWithinPartitions("shard", "visiting")
            .mapInArrow(search, "a long, b long"))


def _trees(forest: Forest) -> list[int]:
    def leaves(node) -> int:
        return 1 if not isinstance(node, tuple) else leaves(node[1]) + leaves(node[2])
    return [t for t, root in enumerate(forest.roots) for _ in range(leaves(root))]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, Iterator[np.ndarray]]]:
    """Shards of rows sorted by (shard, visiting): number, home fingerprints, chunks of
    visitors (one empty chunk if there are none).  Only the homes and one chunk are held."""
    def pieces():
        for batch in batches:
            s = batch.column("shard").to_numpy()
            v = batch.column("visiting").to_numpy(zero_copy_only=False)
            x = batch.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (v[1:] != v[:-1])) + 1).tolist(), len(s)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    yield int(s[a]), bool(v[a]), x[a:b]

    stream = pieces()
    head = [next(stream, None)]

    def guests(number: int) -> Iterator[np.ndarray]:
        held, size = [], 0
        while head[0] is not None and head[0][0] == number:
            held.append(head[0][2])
            size += len(held[-1])
            head[0] = next(stream, None)
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
        yield np.concatenate(held) if held else np.zeros(0, np.uint64)

    while head[0] is not None:
        number, home = head[0][0], []
        while head[0] is not None and head[0][0] == number and not head[0][1]:
            home.append(head[0][2])
            head[0] = next(stream, None)
        rest = guests(number)
        yield number, np.concatenate(home) if home else np.zeros(0, np.uint64), rest
        for _ in rest:  # whatever the caller left
            pass


# ---- documents ----------------------------------------------------------------------------------

def simhash_components(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, shard: int = SHARD,
                       sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_same for each row of ``docs``.

    ``component_id`` is the least doc_id reachable over links between
    fingerprints at most ``radius`` bits apart, ``n_same`` the number of rows with the
    same fingerprint.  Words are lower-cased (A-Z) runs of characters other than 0x20 and
    0x09-0x0D; fewer words than ``width`` make one shingle.  A null, empty or blank text
    has the fingerprint zero and is linked like any other.  A null doc_id
    stays null and is never the least one (a component of such rows only has a null id);
    repeated rows appear each; texts of any length are read whole; an empty table gives
    none; other columns are not read.
    """
    rows = materialize(fingerprints(docs, width), "simhash")
    same = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")), "simhash-groups")
    total, n_rows = same.agg(F.count(F.lit(1)), F.sum("n")).first()
    links = materialize(near_links(same.select("fp"), total, radius, shard, sample, leaf).distinct(), "simhash-links")
    comp = materialize(connected_components(links), "simhash-components")
    linked = same.join(sized(comp.withColumnRenamed("k", "fp")), "fp")
    low = linked.groupBy("c").agg(F.min("low").alias("c_low"))
    named = linked.join(sized(low), "c").select("fp", "c_low")
    names = same.join(sized(materialize(named, "simhash-names")), "fp", "left").select(
        "fp", "n", F.coalesce("c_low", "low").alias("component_id"))
    # fewer than 1 / HOT_SHARE fingerprints can hold more than that share of the rows
    names = materialize(names, "simhash-names")
    hot = F.col("n") > F.lit((n_rows or 0) * HOT_SHARE)
    common = names.where(hot).select("fp", F.col("n").alias("hot_n"), F.col("component_id").alias("hot_id"))
    out = rows.join(F.broadcast(common), "fp", "left")
    out = (out.where("hot_n IS NOT NULL").select("doc_id", "fp", F.col("hot_n").alias("n"), F.col("hot_id").alias("component_id"))
           .union(out.where("hot_n IS NULL").join(sized(names.where(~hot)), "fp").select("doc_id", "fp", "n", "component_id")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                      F.col("n").alias("n_same"))
