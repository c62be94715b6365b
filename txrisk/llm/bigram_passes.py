"""Log perplexity of all texts under the bigram model that the same texts make.

``perplexity.fit`` and ``score`` keep a table of log probabilities and serve
any texts.  Where the texts that are counted are those that are scored, as in
``judge_quality``, neither that table nor two shuffles of all bigrams are
needed.  Texts are hashed once and stored as runs: a run has a list of its
different words and each word's place in the list, some 60 % of the Parquet
that was read.  Buckets by first word are then worked on in a few parts, so
that only one part's bigrams are shuffled at a time: first the bigrams of each
run, from which a bucket tells how many different words it saw before each
word; once these are summed, the bigrams with the texts that hold them, and
the bucket answers with sums for each text.

Very frequent words (at least ``OFTEN`` of all, so at most 2^12) would fill a
bucket: their bigrams go by both words, and what the buckets saw of such a
word is summed between the two steps.  Which words these are decides only
where bigrams go, never what a score is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm import perplexity as Q
from txrisk.llm.spark_io import conf_int, discard, give_back, materialize, sized, stored, text_slices, tidy
from txrisk.llm.words import mix

RUN_WORDS = 2_000_000      # of a run, about
BUCKET_BYTES = 8 << 20     # of text for each bucket
PART_BYTES = 32 << 20      # of text for each part, in up to
PARTS = 4                  # parts
OFTEN = 2.0**-12           # of all words, from which a word is a frequent one
KEY_BITS = 63              # for a bigram and a text as one number
ONLY, COPY, FIRST = 1, 2, 3  # a row whose text no other has; one of several; a text that several have, once

_SCORES = Q.SCORES.split(", ")
TOKENS = ", ".join(["slice long, place long", *_SCORES,
                    "counted boolean, words binary, ids binary, sizes binary, often array<long>, often_n array<long>"])
BIGRAMS = "bucket int, slice long, counted boolean, before binary, after binary, many binary, places binary, counts binary"
ASKED = ("home int, bucket int, keys binary, counts binary, often array<long>, total array<long>, ones array<long>, "
         "twos array<long>, more array<long>")
SUMS = "slice long, places binary, sums binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(),
          "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of a schema; columns that are not given are null."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k])
                                       for c, k in fields], [c for c, _ in fields])


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.Table.from_batches([_batch(schema, len(rows), **{c: [r.get(c) for r in rows] for c in names})])


def _zip(*parts: bytes) -> bytes:
    """Parts one after another, compressed; their sizes first."""
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    raw = b"".join(parts)
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<i8", 1)[0])
    cut = np.cumsum([0, *np.frombuffer(b, "<i8", n, 8)]).tolist()
    raw = pa.decompress(memoryview(b)[8 * n + 8:], cut[-1], codec="zstd", asbytes=True) if cut[-1] else b""
    return [raw[x:y] for x, y in zip(cut[:-1], cut[1:])]


def _starts(a: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


# --- runs: the words of many texts ------------------------------------------
class _Run:
    def __init__(self, slice_id: int, counted: bool) -> None:
        self.slice, self.counted, self.texts, self.waiting = slice_id, counted, 0, 0
        self.words: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of the texts in this run."""
        self.words.append(words)
        self.sizes.append(sizes)
        self.waiting += len(words)
        self.texts += len(sizes)
        return np.arange(self.texts - len(sizes), self.texts)

    def batch(self) -> pa.RecordBatch:
        own, ids, n = np.unique(np.concatenate(self.words), return_inverse=True, return_counts=True)
        order = np.lexsort((own, -np.frexp(n)[1]))  # frequent words first: small numbers for most
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        often = np.flatnonzero(n >= max(1.0, OFTEN * self.waiting))
        return _batch(TOKENS, 1, slice=[self.slice], counted=[self.counted], words=[_zip(Q._pack(own[order]))],
                      ids=[_zip(Q._planes(rank[ids]))], sizes=[_zip(Q._planes(np.concatenate(self.sizes)))],
                      often=[own[often].astype(np.int64)], often_n=[n[often]])


def with_roles(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and role of each row, and each text that several rows have once more."""
    keyed = docs.select("doc_id", "lang", "text", F.unhex(F.md5(F.concat_ws(
        "\0", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))).alias("_key"))
    copies = sized(materialize(keyed.groupBy("_key").count().where("count > 1").select("_key"), "quality-copies"))
    rows = keyed.join(copies.withColumn("_copy", F.lit(COPY)), "_key", "left")
    one = (keyed.select("lang", "text", "_key").join(copies, "_key", "left_semi").groupBy("_key")
           .agg(F.first(F.struct("lang", "text")).alias("t")))
    return (rows.select("doc_id", "lang", "text", F.coalesce("_copy", F.lit(ONLY)).alias("role"))
            .unionByName(one.select(F.lit(None).cast("long").alias("doc_id"), "t.lang", "t.text", F.lit(FIRST).alias("role"))))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The base rules for each row, and the words of all in runs."""
    next_slice, held = TaskContext.get().partitionId() << 32, {}
    for rows, buf, off in text_slices(batches, limit=1 << 20):
        w, h = Q._word_hashes(rows, buf, off)
        words, n = np.maximum(h & Q._WORD, np.uint64(1)), np.diff(w.ptr)
        role = rows.column("role").to_numpy(zero_copy_only=False)
        slices, places = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for counted in (True, False):
            mine = (role != COPY) == counted
            if mine.any():
                if counted not in held:
                    held[counted], next_slice = _Run(next_slice, counted), next_slice + 1
                slices[mine] = held[counted].slice
                places[mine] = held[counted].add(words[np.repeat(mine, n)], n[mine])
        some = np.flatnonzero(role != FIRST)
        yield _batch(TOKENS, len(some), slice=slices[some], place=places[some],
                     **{c: v.take(pa.array(some)) if isinstance(v, pa.Array) else v[some]
                        for c, v in Q.base_rules(rows, buf, off, w, h).items()})
        for counted in [c for c, r in held.items() if r.waiting > RUN_WORDS]:
            yield held.pop(counted).batch()
    for run in held.values():
        if run.waiting:
            yield run.batch()


# --- bigrams of runs, for buckets --------------------------------------------
def _code(before: np.ndarray, after: np.ndarray) -> tuple[bytes, bytes]:
    """Different bigrams in rising order: each word is written once, and how far
    a second word lies from the one before it in the list of second words."""
    first = _starts(before)
    own, rank = np.unique(after, return_inverse=True)
    step = np.diff(rank, prepend=0)
    step[first] = rank[first]
    size = np.diff(np.append(first, len(before)))
    return _zip(Q._pack(before[first]), Q._planes(size)), _zip(Q._pack(own), Q._planes(step))


def _decode(before: bytes, after: bytes) -> tuple[np.ndarray, ...]:
    """First words, how many bigrams each begins, second words, and the place of each bigram's among them."""
    words, size = _unzip(before)
    words, size = Q._unpack(words), Q._unplanes(size)
    own, step = _unzip(after)
    up = np.cumsum(step := Q._unplanes(step))
    first = np.cumsum(size) - size
    return words, size, Q._unpack(own), up - np.repeat(up[first] - step[first], size)


def _is_often(words: np.ndarray, often: np.ndarray) -> np.ndarray:
    if len(often) == 0:
        return np.zeros(len(words), bool)
    return often[np.minimum(np.searchsorted(often, words), len(often) - 1)] == words


def _homes(before: np.ndarray, after: np.ndarray, often: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each bigram: by its first word, but by both for frequent ones."""
    both = (before == Q._START) | _is_often(before, often)
    return Q._home(np.where(both, mix(mix(before) + after) >> np.uint64(16), before), 48, buckets)


def _bigrams(row: dict, often: np.ndarray, buckets: int, chosen: tuple[int, int], texts: bool) -> Iterator[dict]:
    """A run's bigrams of the chosen buckets, with the texts that hold them if asked for."""
    words = Q._unpack(_unzip(row["words"])[0])
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    words = np.concatenate([[Q._START], words[order]]).astype(np.uint64)
    after = rank[Q._unplanes(_unzip(row["ids"])[0])] + 1
    size = Q._unplanes(_unzip(row["sizes"])[0])
    before = np.concatenate([[0], after[:-1]])
    before[(np.cumsum(size) - size)[size > 0]] = 0
    # most first words have one bucket, so the others' bigrams need no closer look
    by_word = Q._home(words, 48, buckets).astype(np.int64)
    near = (by_word >= chosen[0]) & (by_word < chosen[1]) | _is_often(words, often)
    near[0] = True
    near = near[before]
    bits, low = len(words).bit_length(), len(size).bit_length() if texts else 0
    key = (before[near] << bits) | after[near]
    if 2 * bits + low <= KEY_BITS:
        if texts:
            key = (key << low) | np.repeat(np.arange(len(size)), size)[near]
        key.sort()
        place, key = key & ((1 << low) - 1), key >> low
    else:  # a run of one huge text or of very many
        place = np.repeat(np.arange(len(size)), size)[near]
        by = np.lexsort((place, key))
        place, key = place[by], key[by]
    new = _starts(key)
    own = key[new]
    first, second = words[own >> bits], words[own & ((1 << bits) - 1)]
    home = _homes(first, second, often, buckets).astype(np.int64)
    ends = np.append(new, len(key))
    for i, at in Q._split(home.astype(np.uint64), buckets):
        if not chosen[0] <= i < chosen[1]:
            continue
        before_, after_ = _code(first[at], second[at])
        out = {"bucket": i, "slice": row["slice"], "counted": row["counted"], "before": before_, "after": after_}
        if texts:
            n = ends[at + 1] - ends[at]
            at_posting = np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            p = place[at_posting]
            which = np.repeat(np.arange(len(at)), n)
            change = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (p[1:] != p[:-1])]))
            out |= {"many": _zip(Q._planes(np.bincount(which[change], minlength=len(at)))), "places": _zip(Q._planes(p[change])),
                    "counts": _zip(Q._planes(np.diff(np.append(change, len(p)))))}
        else:
            out["counts"] = _zip(Q._planes(ends[at + 1] - ends[at]))
        yield out


def _merged(pieces: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The different bigrams of several lists, in rising order: first words, second
    words and the place of each bigram's among them; and the place of the lists' bigrams."""
    words, size, own, at = zip(*pieces)
    b, bi = np.unique(np.concatenate(words), return_inverse=True)
    a, ai = np.unique(np.concatenate(own), return_inverse=True)
    shift = np.cumsum([0, *map(len, own)])
    keys, inv = np.unique(np.repeat(bi, np.concatenate(size)) * len(a)
                          + ai[np.concatenate([x + k for x, k in zip(at, shift)])], return_inverse=True)
    return b[keys // len(a)], a, keys % len(a), inv


def score_all(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The base rules and the log perplexity of each row (null without words), as
    ``perplexity.score`` gives them for the model of the same rows; and the
    folders that may go once the rows were read."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(conf_int(spark, "spark.sql.shuffle.partitions", 200), -(-size // BUCKET_BYTES))
    parts = max(1, min(PARTS, -(-size // PART_BYTES)))
    cuts = [buckets * k // parts for k in range(parts + 1)]
    tokens, tokens_at = stored(with_roles(docs).mapInArrow(tidy(_tokens), TOKENS), "quality-tokens")
    runs = tokens.where("words IS NOT NULL").select("slice", "counted", "words", "ids", "sizes")
    n_words = tokens.where("words IS NULL").agg(F.sum("n_words")).first()[0] or 0
    seen_often = (tokens.where("words IS NOT NULL").select(F.explode(F.arrays_zip("often", "often_n")).alias("x"))
                  .groupBy(F.col("x.often").alias("word")).agg(F.sum("x.often_n").alias("n"))
                  .where(F.col("n") >= OFTEN * n_words).select("word").collect())  # at most 1 / OFTEN or so
    often = np.sort(np.array([r["word"] for r in seen_often], np.uint64))

    def bigrams(chosen: tuple[int, int], texts: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    for out in _bigrams(b.slice(i, 1).to_pylist()[0], often, buckets, chosen, texts):
                        yield _batch(BIGRAMS, 1, **{c: [v] for c, v in out.items()})
        return (runs if texts else runs.where("counted")).mapInArrow(tidy(run), BIGRAMS)

    def ask(group: pa.Table) -> pa.Table:
        """How many words this bucket saw before each word, by that word; what it
        saw of frequent words; how many of its bigrams have which count."""
        pieces = [_decode(x.as_py(), y.as_py()) for x, y in zip(group.column("before"), group.column("after"))]
        before, own, at, inv = _merged(pieces)
        n = np.concatenate([Q._unplanes(_unzip(c.as_py())[0]) for c in group.column("counts")])
        counts = np.bincount(inv, n, len(before)).astype(np.int64)
        bucket = group.column("bucket")[0].as_py()
        c = np.bincount(at, before != Q._START, len(own)).astype(np.int64)
        out = [{"home": i, "bucket": bucket, "keys": _zip(Q._pack(own[o])), "counts": _zip(Q._planes(c[o]))}
               for i, o in Q._split(Q._home(own, 48, buckets), buckets)]
        known = _is_often(before, often)
        words, at = np.unique(before[known], return_inverse=True)
        sums = {k: np.bincount(at, x, len(words)).astype(np.int64) for k, x in (
            ("total", counts[known]), ("ones", counts[known] == 1), ("twos", counts[known] == 2), ("more", counts[known] > 2))}
        tally = np.array(Q._tally(counts[before != Q._START]), "<i8").tobytes()
        table = _rows(ASKED, [*out, {"counts": tally, "often": words.astype(np.int64), **sums}])
        give_back()
        return table

    asked, asked_at = zip(*(stored(bigrams((x, y), False).groupBy("bucket").applyInArrow(ask, ASKED), "quality-asked")
                            for x, y in zip(cuts[:-1], cuts[1:])))
    asked = reduce(DataFrame.unionByName, asked)
    *tally, = Q._added(asked.where("home IS NULL"), 7)
    d = Q._discounts(tally[:4])
    of_often = (asked.where("home IS NULL").select(F.explode(F.arrays_zip("often", "total", "ones", "twos", "more")).alias("x"))
                .groupBy(F.col("x.often").alias("word"))
                .agg(*[F.sum(f"x.{c}").alias(c) for c in ("total", "ones", "twos", "more")]).orderBy("word").collect())
    often_total = np.array([r["total"] for r in of_often], np.float64)
    often_cost = np.array([r["ones"] * d[1] + r["twos"] * d[2] + r["more"] * d[3] for r in of_often], np.float64)
    often_words = np.array([r["word"] for r in of_often], np.uint64)

    def answer(group: pa.Table) -> pa.Table:
        keys = [Q._unpack(_unzip(k.as_py())[0]) for k in group.column("keys")]
        own, inv = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([Q._unplanes(_unzip(c.as_py())[0]) for c in group.column("counts")])
        left = np.bincount(inv, n, len(own)).astype(np.int64)  # different words before each word
        cut = np.cumsum([0, *map(len, keys)])
        home = group.column("home")[0].as_py()
        rows = [{"bucket": b.as_py(), "home": home, "counts": _zip(Q._planes(left[inv[x:y]]))}
                for b, x, y in zip(group.column("bucket"), cut[:-1], cut[1:])]
        return _rows(Q.LEFT, [*rows, {"counts": np.array(Q._tally(left), "<i8").tobytes()}])

    left, left_at = stored(asked.where("home IS NOT NULL").select("home", "bucket", "keys", "counts")
                           .groupBy("home").applyInArrow(answer, Q.LEFT), "quality-left")
    discard(spark, *asked_at)
    *few, more, seen, types = Q._added(left, 7)
    low = Q._discounts(few)
    # no discount is above its count, so what they take adds up from how many words have which count
    taken = low[1] * few[0] + low[2] * few[1] + low[3] * more
    floor, seen = taken / (types + 1), max(seen, 1)

    def add_up(group: pa.Table, sums: pa.Table) -> pa.Table:
        """What this bucket's bigrams add to the log probability of each text."""
        if group.num_rows == 0:
            return _rows(SUMS, [])
        pieces = [_decode(x.as_py(), y.as_py()) for x, y in zip(group.column("before"), group.column("after"))]
        cut = np.cumsum([0, *(len(x[-1]) for x in pieces)])
        before, own, at, inv = _merged(pieces)
        del pieces
        counts = np.zeros(len(before), np.int64)
        for k, (m, c, counted) in enumerate(zip(*(group.column(x) for x in ("many", "counts", "counted")))):
            if counted.as_py():  # a bigram is once in a run's list
                many = Q._unplanes(_unzip(m.as_py())[0])
                counts[inv[cut[k]:cut[k + 1]]] += np.add.reduceat(Q._unplanes(_unzip(c.as_py())[0]), np.cumsum(many) - many)
        n = np.zeros(len(own), np.int64)
        of_home = dict(zip(sums.column("home").to_pylist(), sums.column("counts").to_pylist()))
        for i, o in Q._split(Q._home(own, 48, buckets), buckets):
            n[o] = Q._unplanes(_unzip(of_home[i])[0])
        unigram = ((np.maximum(n - low[np.minimum(n, 3)], 0) + floor) / seen)[at]
        first = _starts(before)
        cost = d[np.minimum(counts, 3)]
        total, spent = np.add.reduceat(counts, first).astype(np.float64), np.add.reduceat(cost, first)
        if len(often_words):
            at = np.minimum(np.searchsorted(often_words, before[first]), len(often_words) - 1)
            known = often_words[at] == before[first]
            total[known], spent[known] = often_total[at[known]], often_cost[at[known]]
        size = np.diff(np.append(first, len(before)))
        total, backoff = np.repeat(total, size), np.maximum(np.repeat(spent / total, size), 1e-9)
        p = np.where(before == Q._START, unigram, np.maximum(counts - cost, 0) / total + backoff * unigram)
        log = -np.round(np.log(np.maximum(p, 1e-12)) * Q._ONE).astype(np.int64)
        out = []
        for k, (s, m, c, t) in enumerate(zip(*(group.column(x) for x in ("slice", "many", "counts", "places")))):
            add = np.repeat(log[inv[cut[k]:cut[k + 1]]], Q._unplanes(_unzip(m.as_py())[0])) * Q._unplanes(_unzip(c.as_py())[0])
            places = Q._unplanes(_unzip(t.as_py())[0])
            there = np.flatnonzero(np.bincount(places))
            whole = np.bincount(places, add)[there].astype(np.int64)  # whole numbers below 2^53
            out.append({"slice": s.as_py(), "places": _zip(Q._planes(there)), "sums": _zip(Q._planes(whole))})
        table = _rows(SUMS, out)
        del group, before, at, inv, counts, log
        give_back()
        return table

    def join(group: pa.Table) -> pa.Table:
        places = [Q._unplanes(_unzip(p.as_py())[0]) for p in group.column("places")]
        total = np.zeros(1 + max(int(p[-1]) for p in places), np.int64)
        for p, x in zip(places, group.column("sums")):
            total[p] += Q._unplanes(_unzip(x.as_py())[0])
        return pa.table({"slice": pa.array([group.column("slice")[0].as_py()] * len(total), pa.int64()),
                         "place": pa.array(np.arange(len(total)), pa.int64()), "log_sum": pa.array(total, pa.int64())})

    of_bucket = left.where("bucket IS NOT NULL")
    sums, sums_at = zip(*(stored(
        bigrams((x, y), True).groupBy("bucket")
        .cogroup(of_bucket.where((F.col("bucket") >= x) & (F.col("bucket") < y)).groupBy("bucket"))
        .applyInArrow(add_up, SUMS), "quality-sums") for x, y in zip(cuts[:-1], cuts[1:])))
    added = (reduce(DataFrame.unionByName, sums).groupBy("slice")
             .applyInArrow(join, "slice long, place long, log_sum long"))
    scores = (tokens.where("words IS NULL").join(added, ["slice", "place"], "left")
              .select(*(c.split()[0] for c in _SCORES),
                      F.when(F.col("n_words") > 0, F.col("log_sum") / F.lit(Q._ONE) / F.col("n_words")).alias("log_ppl")))
    return scores, [tokens_at, left_at, *sums_at]
