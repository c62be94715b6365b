"""Operator 8: n-gram Jaccard join, size-aware with heavy and light sets.

Texts with equal shingle sets form one class; the join runs on classes.
*Light* sets (few shingles) enumerate the subsets of every size that a linked
partner must share: sets that meet in a subset are linked.  All other pairs
hold a *heavy* set and meet in inverted lists of the rarest shingles.  The
size where heavy begins is chosen by cost from the histogram of set sizes.

Lists are never turned into all their pairs.  Rounds compare the members of a
list with one hub and join what links into components; a last step compares
only members of different components.  Every link found is checked on the
full sets.  Shingles are 64-bit hashes, so within a pair of sets two
different shingles coincide with a chance of about n^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.components import connected_components, extend_components
from txrisk.llm.spark_io import materialize, sized, text_slices, tidy
from txrisk.llm.words import LOWER, find_words, hash_ranges, mix, shingle_set

MAX_LIGHT = 32           # largest size at which the light side is considered
COMMON_SHARE = 2.0**-20  # share of repeated shingles from which one counts as common
LEAST_COMMON = 3
RUN_SHINGLES = 4_000_000  # shingles that a task counts at a time
STAR_ROUNDS = 2
HELD_SETS = 1 << 20      # names of sets that a task remembers
ENTRY_COST = 8           # subsets that cost as much as a list entry, which also leads to pairs to check


class Threshold:
    """Jaccard >= num/den in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, n: int, m: int) -> int:
        """Least overlap of linked sets of sizes n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes m >= n of sets that a set of size n can link to."""
        return range(n, n * 100 // self.percent + 1)

    def least(self, n):
        """Least overlap with any partner."""
        return -(-self.percent * n // 100)

    def linked(self, both: Column, n: Column, m: Column) -> Column:
        return (100 + self.percent) * both >= self.percent * (n + m)

    def may_start(self, n: Column, at_n: Column, m: Column, at_m: Column) -> Column:
        """Whether the first common shingle of linked sets can be at these places."""
        both = F.floor((self.percent * (n + m) + 99 + self.percent) / F.lit(100 + self.percent))
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & (at_n <= n - both) & (at_m <= m - both)


def _sets(buf: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Shingle set of each text (sorted, distinct)."""
    low = LOWER[buf]
    w = find_words(low, off)
    h = hash_ranges(low, w.start, w.end)
    for a, b in zip(w.ptr[:-1], w.ptr[1:]):
        yield shingle_set(h[a:b], width)


def _key(s: np.ndarray) -> bytes:
    """128-bit name of a set."""
    with np.errstate(over="ignore"):
        return np.array([np.add.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))],
                        "<u8").tobytes()


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^j >= n hash buckets, at least 64, as bits."""
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _least_difference(a: bytes, b: bytes) -> int:
    """How many shingles two sets with these sketches differ by at least: a
    bucket of other parity holds one.  The longer sketch is folded first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, k, sketch: size, name and sketch of each text's set; the
    latter two are null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in text_slices(batches):
            n, k, sketch = [], [], []
            for s in _sets(buf, off, width):
                n.append(len(s))
                k.append(_key(s) if len(s) else None)
                sketch.append(_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.binary()),
                 pa.array(sketch, pa.binary())], ["doc_id", "n", "k", "sketch"])
    return _slim(docs).mapInArrow(tidy(run), "doc_id long, n long, k binary, sketch binary")


def choose_boundary(sizes: dict[int, int], t: Threshold) -> int:
    """Largest light size of least cost: subsets of light sets against the list
    entries of sets that may meet a heavy one."""
    def subsets(n: int) -> int:
        own = sum(comb(n, t.overlap(n, m)) for m in t.partners(n))
        return own + sum(comb(n, t.overlap(m, n)) for m in range(t.least(n), n))

    def entries(n: int) -> int:
        return ENTRY_COST * (n - t.least(n) + 1)

    best, cost = 0, None
    for x in range(MAX_LIGHT + 1):
        c = (sum(k * subsets(n) for n, k in sizes.items() if n <= x)
             + sum(k * entries(n) for n, k in sizes.items() if n >= t.least(x + 1)))
        if cost is None or c < cost:
            best, cost = x, c
    return best


def _subset_hashes(s: np.ndarray, t: Threshold, light: int) -> Iterator[tuple[np.ndarray, bool]]:
    """For each pair of light sizes of which one is the set's: hashes of its
    subsets of the overlap they need, and whether the set has the smaller size."""
    n = len(s)
    for a, b in [(n, m) for m in t.partners(n)] + [(m, n) for m in range(t.least(n), n)]:
        if b <= light:
            subs = np.array(list(combinations(s.tolist(), t.overlap(a, b))), np.uint64)
            h = np.full(len(subs), a * 1000 + b, np.uint64)
            for col in subs.T:
                h = mix(h + col)
            yield h, n == a


def subset_links(subsets: DataFrame) -> DataFrame:
    """a, b: pairs of light sets that share a subset (s, k, small) their link needs."""
    # the hub is a set of the smaller size: it links to every other in the group
    hubs = subsets.groupBy("s").agg(F.min(F.when(F.col("small"), F.col("k"))).alias("a"),
                                    F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    hubs = hubs.where("a IS NOT NULL AND _lo <> _hi").select("s", "a")
    return subsets.join(hubs, "s").where("k <> a").select("a", F.col("k").alias("b")).distinct()


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (sorted) and the power of two of their counts.

    A task counts shingles over runs of texts and reports those it met twice
    or more; the sums decide the order of list entries, and any fixed order
    gives the same links.  At most 1 / COMMON_SHARE shingles can reach the share.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def report() -> pa.RecordBatch:
            s, c = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            twice = c > 1
            return pa.RecordBatch.from_arrays([pa.array(s[twice].view(np.int64)), pa.array(c[twice].astype(np.int64))],
                                              ["s", "c"])

        for _, buf, off in text_slices(batches):
            held.extend(_sets(buf, off, width))
            if sum(map(len, held)) > RUN_SHINGLES:
                yield report()
        yield report()

    counts = materialize(_slim(docs).mapInArrow(tidy(run), "s long, c long").groupBy("s").agg(F.sum("c").alias("c")),
                         "jaccard-shingles")
    total = counts.agg(F.sum("c")).first()[0] or 0
    rows = counts.where(F.col("c") > F.lit(max(LEAST_COMMON, total * COMMON_SHARE))).toPandas()
    s = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.log2(rows["c"].to_numpy(np.float64)[order] + 1).astype(np.uint8)


def _ordered(s: np.ndarray, common: np.ndarray, power: np.ndarray) -> np.ndarray:
    """A set's shingles, rare before common, then by hash."""
    if len(common) == 0:
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    rank = np.where(common[at] == s, power[at], 0)
    return s[np.argsort(rank, kind="stable")]


def list_entries(docs: DataFrame, width: int, t: Threshold, light: int,
                 common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """s, k, n, at, small: list entries, and subsets of light sets (``at`` null).

    Sets that may meet a heavy one enter the lists of their first
    n - least_overlap + 1 shingles (rare before common, then by hash): linked
    sets share one of these.  ``at`` is the shingle's place in that order.  A
    task enters a set once, however many of its texts have it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    least = t.least(light + 1)  # a heavy set has more than `light` shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, power = shared.value
        seen: set[bytes] = set()  # sets that this task has entered
        for _, buf, off in text_slices(batches):
            parts, keys, sizes, at, small = [], [], [], [], []
            for s in _sets(buf, off, width):
                n, key = len(s), _key(s)
                if key in seen:
                    continue
                if len(seen) >= HELD_SETS:
                    seen.clear()  # entered again, and made one where the lists are
                seen.add(key)
                if 0 < n <= light:
                    for h, is_small in _subset_hashes(s, t, light):
                        parts.append(h)
                        keys.append(key)
                        sizes.append(n)
                        at.append(np.full(len(h), -1))
                        small.append(np.full(len(h), is_small))
                if n and n >= least:
                    p = n - t.least(n) + 1
                    parts.append(_ordered(s, hot, power)[:p])
                    keys.append(key)
                    sizes.append(n)
                    at.append(np.arange(p))
                    small.append(np.zeros(p, bool))
            if not parts:
                continue
            many = [len(p) for p in parts]
            place = np.concatenate(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts).view(np.int64)),
                 pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), many))),
                 pa.array(np.repeat(np.array(sizes, np.int64), many)),
                 pa.array(place.astype(np.int64), mask=place < 0), pa.array(np.concatenate(small))],
                ["s", "k", "n", "at", "small"])

    return _slim(docs).mapInArrow(tidy(run), "s long, k binary, n long, at long, small boolean")


def sketch_pairs(pairs: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """Of candidate pairs (a, b), those that their sketches don't rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))
            ok = [_least_difference(x, y) <= n + m - 2 * t.overlap(n, m) for n, m, x, y in zip(na, nb, xa, xb)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: classes.select(F.col("k").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("x" + c))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(run), "a binary, b binary")


def check_pairs(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, t: Threshold) -> DataFrame:
    """Of candidate pairs (a, b), those whose whole sets are linked."""
    pairs = materialize(sketch_pairs(pairs, classes, t), "jaccard-pairs")
    need = materialize(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
                       .join(classes, "k").select("doc_id").distinct(), "jaccard-need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, off in text_slices(batches):
            sets = [s for s in _sets(buf, off, width) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(s) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["k", "s"])

    sets = materialize(_slim(docs).join(sized(need), "doc_id", "left_semi")
                       .mapInArrow(tidy(run), "k binary, s array<long>").dropDuplicates(["k"]), "jaccard-sets")
    with_b = pairs.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(t.linked(shared, F.size("sa"), F.size("sb"))).select("a", "b")


def _outside(members: DataFrame) -> DataFrame:
    """Entries with ``outside``: not of their list's largest component."""
    largest = (members.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m"))
               .groupBy("s").agg(F.max(F.struct("m", "c")).alias("top")).select("s", F.col("top.c").alias("_top")))
    return members.join(largest, "s").withColumn("outside", F.col("c") != F.col("_top")).drop("_top")


def similar_components(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a set has the distinct
    ``width``-word shingles, or the whole sequence where there are fewer words.
    Two sets link at Jaccard >= percent / 100; the component is the least id
    reachable.  Null and empty texts, or texts without words, have no shingles
    and are their own component.  A row with a null id has the component of the
    rows with its set; if all of them have null ids, they link with no other set
    and the component is null.  Repeated rows share a class.  An empty table
    gives no rows; other columns are not read.
    """
    t = Threshold(percent)
    table = materialize(set_table(docs, width), "jaccard-table")
    sizes = {r["n"]: r["c"] for r in table.where(F.col("n").between(1, 2 * MAX_LIGHT))
             .groupBy("n").agg(F.countDistinct("k").alias("c")).collect()}
    classes = materialize(table.where("k IS NOT NULL").groupBy("k").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-sets")
    light = choose_boundary(sizes, t)
    comp = class_links(docs, classes, width, t, light).select(F.col("a").alias("k"), F.col("b").alias("c"))
    named = classes.join(comp, "k", "left").withColumn("c", F.coalesce("c", "k"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_class = materialize(named.select("k", "c").join(least, "c").select("k", "component_id"), "jaccard-classes")
    return _attach(table, of_class)


def _attach(table: DataFrame, of_class: DataFrame) -> DataFrame:
    out = table.join(of_class, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                      .alias("component_id"))


def class_links(docs: DataFrame, classes: DataFrame, width: int, t: Threshold, light: int) -> DataFrame:
    """a, b: each class with links, and the least class that it is connected with."""
    spark: SparkSession = docs.sparkSession
    comp = spark.createDataFrame([], "k binary, c binary")
    common = common_shingles(docs, width)
    # one shuffle by shingle: equal sets are made one, and lists of a single set end there
    at_list = list_entries(docs, width, t, light, common).repartition("s")
    once = at_list.groupBy("s", "k", F.col("at").isNull().alias("sub")).agg(
        F.first("n").alias("n"), F.min("at").alias("at"), F.max("small").alias("small"))
    # this side reads all columns, so that it has the same shuffle and entries are not made a second time
    name, rest = F.xxhash64("k"), F.xxhash64("n", "at", "small")
    several = (at_list.groupBy("s").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"), F.max(rest).alias("_rest"))
               .where("_lo <> _hi OR _rest IS NULL").select("s"))
    entries = materialize(once.join(several, "s", "left_semi"), "jaccard-entries")
    if light:
        pairs = subset_links(entries.where("sub").select("s", "k", "small"))
        found = materialize(check_pairs(docs, pairs, classes, width, t), "jaccard-light-links")
        comp = materialize(connected_components(found), "jaccard-comp")

    lists = entries.where("NOT sub").select("s", "k", "n", "at")
    rank = materialize(lists.groupBy("k").agg(F.count(F.lit(1)).alias("shared")), "jaccard-rank")
    lists = materialize(lists.join(sized(rank), "k"), "jaccard-lists")

    for turn in range(STAR_ROUNDS):
        members = materialize(_open_lists(lists, comp), "jaccard-open")
        # the hub: the set that shares most of its entries, later of those outside the largest component
        able = _outside(members).where("outside") if turn else members
        hub = able.groupBy("s").agg(F.max(F.struct("shared", "k", "n", "c", "at")).alias("hub"))
        star = (members.join(hub, "s").where(F.col("c") != F.col("hub.c"))
                .where(t.may_start(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at")))
                .select(F.col("hub.k").alias("a"), F.col("k").alias("b")).distinct())
        new = materialize(check_pairs(docs, star, classes, width, t), "jaccard-star-links")
        if new.limit(1).count() == 0:
            break
        comp = materialize(extend_components(comp, new), "jaccard-comp")

    # what is left: members outside a list's largest component, against all others
    members = materialize(_open_lists(lists, comp), "jaccard-open")
    marked = _outside(members)
    x, y = marked.where("outside").alias("x"), marked.alias("y")
    rest = (x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.c") != F.col("y.c"))
                   & (~F.col("y.outside") | (F.col("x.k") < F.col("y.k")))
                   & t.may_start(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")))
            .select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct())
    last = materialize(check_pairs(docs, rest, classes, width, t), "jaccard-last-links")
    comp = materialize(extend_components(comp, last), "jaccard-comp")
    return comp.select(F.col("k").alias("a"), F.col("c").alias("b"))


def _open_lists(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries with their component ``c``, of lists that span several components."""
    members = lists.join(sized(comp), "k", "left").withColumn("c", F.coalesce("c", "k"))
    spans = members.groupBy("s").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("s")
    return members.join(spans, "s", "left_semi")


def drop_near_duplicates(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the least id.

    Rows whose text has no shingles (null, empty, blank) stay.  Rows are matched by
    doc_id; rows that repeat an id with the same text are reduced to one.  Rows with a
    null id stay (they cannot be named).  An empty table gives no rows; all
    columns are kept.
    """
    comp = materialize(similar_components(docs, percent, width), "jaccard-rows")
    gone = sized(materialize(comp.where("component_id < doc_id").select("doc_id").distinct(), "jaccard-gone"))
    stay = docs.join(gone, "doc_id", "left_anti")
    if comp.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return stay
    named = stay.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(stay.where("doc_id IS NULL"))
