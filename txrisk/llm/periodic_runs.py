"""Operator 11: maximal repetitions (runs) of words in each text.

For a text and its reversal a suffix tree is built with Ukkonen's algorithm.
An Euler tour of a tree keeps, between neighbouring leaves, the least string
depth it passes; the least of a stretch of those is the depth of the lowest
common ancestor of two leaves, found in constant time, so the longest common
extension of any two positions is too.  By the runs theorem the Lyndon root of
every run is the longest Lyndon word at one of its positions, for the order of
words or for its reverse: 2n candidates, each extended in both directions.

A run of at least ``least`` words holds a stretch of ``least / 2`` words that
recurs, and all its words lie in such stretches.  Words outside of them cut a
text into blocks that are searched one by one; texts in which no stretch
recurs have no block.  Words of a block are numbered by their bytes, so equal
hashes only make a block too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import text_slices
from txrisk.llm.words import find_words, hash_ranges, mix, window_hash

LEAST = 12
RMQ_BLOCK = 32
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """Of positive integers; the end is a 0 that is less than all of them."""

    def __init__(self, symbols: list[int]):
        self.size = len(symbols)
        s = symbols + [0]
        self._build(s)
        self._tour()

    def _build(self, s: list[int]) -> None:
        n, base = len(s), max(s) + 1
        child: dict[int, int] = {}
        start, end, link = [0], [0], [0]
        leaf_of = []
        node = at = length = left = 0
        for i in range(n):
            c = s[i]
            left += 1
            fresh = 0
            while left:
                if not length:
                    at = i
                key = node * base + s[at]
                nxt = child.get(key)
                if nxt is None:
                    child[key] = len(start)
                    leaf_of.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    st = start[nxt]
                    size = end[nxt] - st
                    if length >= size:
                        node = nxt
                        length -= size
                        at += size
                        continue
                    if s[st + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    mid = len(start)
                    child[key] = mid
                    start.append(st)
                    end.append(st + length)
                    link.append(0)
                    start[nxt] = st + length
                    child[mid * base + s[st + length]] = nxt
                    child[mid * base + c] = mid + 1
                    leaf_of.append(mid + 1)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = mid
                    fresh = mid
                left -= 1
                if node == 0 and length:
                    length -= 1
                    at = i - left + 1
                else:
                    node = link[node]
        count = len(start)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        kids = np.fromiter(child.values(), np.int64, len(child))
        child.clear()
        self.base, self.count = base, count
        self.edge = np.array(end, np.int64) - np.array(start, np.int64)
        self.suffix = np.full(count, -1, np.int64)
        self.suffix[leaf_of] = np.arange(n)
        self._parent, self._symbol, self._kids = keys // base, keys % base, kids

    def _children(self, reverse: bool) -> tuple[list, list]:
        """Children of each node, last first (a stack hands them out), and where they begin."""
        sym = np.where(self._symbol > 0, self.base - self._symbol, 0) if reverse else self._symbol
        order = np.lexsort((-sym, self._parent))
        return self._kids[order].tolist(), np.searchsorted(self._parent[order], np.arange(self.count + 1)).tolist()

    def _tour(self) -> None:
        kids, first = self._children(False)
        suffix, edge = self.suffix.tolist(), self.edge.tolist()
        leaves, passed = [], []
        stack = [(0, 0, 0)]
        pop, push = stack.pop, stack.append
        while stack:
            node, depth, least = pop()  # least: depth passed since the leaf before
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                passed.append(least)
                continue
            depth += edge[node]
            a, b = first[node], first[node + 1] - 1
            for k in range(a, b):
                push((kids[k], depth, depth))
            push((kids[b], depth, least))
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.low = Minima(np.array(passed[1:] or [0], np.int64))

    def reverse_rank(self) -> np.ndarray:
        """Rank of each suffix when words are ordered the other way round; the end stays least."""
        kids, first = self._children(True)
        suffix = self.suffix.tolist()
        leaves, stack = [], [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                leaves.append(suffix[node])
            else:
                stack += kids[first[node]:first[node + 1]]
        rank = np.empty(len(leaves), np.int64)
        rank[leaves] = np.arange(len(leaves))
        return rank

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (i <> j)."""
        a, b = self.rank[i], self.rank[j]
        return self.low.over(np.minimum(a, b), np.maximum(a, b) - 1)


class Minima:
    """Least value of any stretch: minima to either end of a block, and a sparse table over blocks."""

    def __init__(self, v: np.ndarray):
        n = -(-len(v) // RMQ_BLOCK)
        grid = np.full(n * RMQ_BLOCK, np.iinfo(np.int64).max, np.int64)
        grid[:len(v)] = v
        self.v, grid = grid, grid.reshape(n, RMQ_BLOCK)
        self.head = np.minimum.accumulate(grid, axis=1).ravel()
        self.tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= n:
            t, k = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-k], t[k:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(v[a:b+1]) of each pair."""
        out = np.minimum(self.tail[a], self.head[b])
        p, q = a // RMQ_BLOCK, b // RMQ_BLOCK
        same = np.flatnonzero(p == q)
        for part in np.array_split(same, -(-len(same) // 65536) or 1):
            if len(part):
                at = a[part][:, None] + np.arange(RMQ_BLOCK)
                rows = self.v[np.minimum(at, b[part][:, None])]
                out[part] = rows.min(axis=1)
        level = np.frexp(np.maximum(q - p - 1, 1).astype(np.float64))[1] - 1
        for k, t in enumerate(self.table):
            far = np.flatnonzero((q - p > 1) & (level == k))
            if len(far):
                out[far] = np.minimum(out[far], np.minimum(t[p[far] + 1], t[q[far] - (1 << k)]))
        return out


def longest_lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position: up to the next lesser suffix."""
    r = rank.tolist()
    n = len(r) - 1
    r[n] = -1
    nxt = [n] * n
    for i in range(n - 1, -1, -1):
        j, x = i + 1, r[i]
        while r[j] > x:
            j = nxt[j]
        nxt[i] = j
    return np.array(nxt, np.int64) - np.arange(n)


def runs_of(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of at least max(least, 2 * period) symbols,
    by start and period.  Symbols are positive."""
    n = len(symbols)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for rank in (ahead.rank, ahead.reverse_rank()):
        period = longest_lyndon(rank)
        i = np.flatnonzero(np.arange(n) + period < n + 1)
        p = period[i]
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        k = np.flatnonzero(i + p < n)
        right[k] = ahead.extension(i[k], i[k] + p[k])
        k = np.flatnonzero(i > 0)
        left[k] = back.extension(n - i[k], n - i[k] - p[k])
        size = left + p + right
        ok = size >= np.maximum(least, 2 * p)
        found.append(np.stack([(i - left)[ok], size[ok], p[ok]], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def recurring_blocks(h: np.ndarray, ptr: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of words covered by windows of ``width`` words met twice in their
    text.  ``h``: word hashes, text d's are ptr[d]:ptr[d+1].  In order."""
    if len(h) < width:
        return []
    text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    inside = np.flatnonzero(text[width - 1:] == text[:len(text) - width + 1])
    key = mix(window_hash(h, width)[inside] ^ mix(text[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, inside[twice], 1)
    np.subtract.at(cover, inside[twice] + width, 1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
        cuts = ptr[np.searchsorted(ptr, a, "right"):np.searchsorted(ptr, b, "left")].tolist()
        out += list(zip([a, *cuts], [*cuts, b]))  # covered stretches of neighbouring texts may touch
    return out


def text_runs(words: list[bytes], blocks: list[tuple[int, int]], least: int) -> np.ndarray:
    """Runs of a text from its blocks (word numbers)."""
    found = []
    for a, b in blocks:
        if b - a >= least:
            ids: dict[bytes, int] = {}
            part = runs_of([ids.setdefault(w, len(ids) + 1) for w in words[a:b]], least)
            found.append(part + np.array([a, 0, 0]))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words that no run contains after its first period, joined by one space."""
    if len(runs) == 0:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(depth, runs[:, 0] + runs[:, 1], 1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, collapsed for each row of ``docs`` (doc_id, text).

    ``runs`` holds every stretch of words with smallest period q and at least
    max(least, 2 q) words that cannot be extended, as (start, length, period)
    by start and period; ``collapsed`` the words outside the repeated part of
    any run, joined by one space.  Words are runs of characters other than
    0x20 and 0x09-0x0D, compared by their bytes.  Texts of any length are read
    whole.  A null or empty text has no words, no runs and an empty result; a
    null doc_id stays null; repeated rows are searched each; an empty table
    gives none; other columns are not read.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in text_slices(batches):
            w = find_words(buf, off)
            blocks = recurring_blocks(hash_ranges(buf, w.start, w.end), w.ptr, least // 2)
            raw, ptr, k = buf.tobytes(), w.ptr.tolist(), 0
            n_words, collapsed, flat, ends = [], [], [], [0]
            for d in range(len(ptr) - 1):
                mine = []
                while k < len(blocks) and blocks[k][0] < ptr[d + 1]:
                    mine.append((blocks[k][0] - ptr[d], blocks[k][1] - ptr[d]))
                    k += 1
                words = raw[off[d]:off[d + 1]].split()
                runs = text_runs(words, mine, least)
                n_words.append(len(words))
                collapsed.append(collapse(words, runs).decode())
                flat.append(runs)
                ends.append(ends[-1] + len(runs))
            flat = np.concatenate(flat)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)],
                                                 ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n_words, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(search, "doc_id long, " + SCHEMA))


def stuttered(doc_id: Column, text: Column) -> Column:
    """The text with a planted repetition, for one document in ten.

    With h = crc32(decimal id), g = h div 10 and n words: if h is a multiple of
    10, words from a = g % n on repeat the first p = 1 + (n - a) div (3 + g % 8)
    of them.  All other texts (also those of a null id) stay as they are.
    """
    h = F.crc32(doc_id.cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(text.cast("string"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = F.when(n > 0, g % n).otherwise(0)
    m = n - a
    p = 1 + F.floor(m / (3 + g % 8))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(m / p).cast("int"))), F.lit(1), m.cast("int"))
    return F.when((h % 10 == 0) & (n > 0),
                  F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def run_digest(runs: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: number of runs, the longest one (ties: least start,
    then least period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    d = runs.withColumns({"_best": best, "_lines": lines})
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("_lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
