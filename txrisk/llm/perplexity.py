"""Operator 2: quality rules with an n-gram perplexity band.

A bigram model with modified Kneser-Ney smoothing is counted by Spark over all
different texts, each once.  Words are told apart by language and every word is
a type of its own: there is no closed vocabulary and no unknown word, so a
language with few texts is read as closely as one with many.  Words are 48-bit
hashes; neither words nor bigrams are gathered.  Tasks send sorted runs of
distinct bigrams to buckets by their first word, which know the sums of each
context; how many words come before a word is summed in buckets by that word
and sent back.  The log probabilities of all bigrams are a table spread by a
hash of the bigram; those with at least ``PAIR_SHARE`` of all words (so at most
2^20) are broadcast instead.  Scoring tasks look common bigrams up themselves
and send the others, sorted and packed, to the table's buckets, which answer
with sums.  Buckets grow in number with the bytes of text, not in size.  Log
probabilities are added as whole multiples of 2^-19: the order of adding does
not matter.

Bands of log perplexity are set per language around the median, in multiples
of the median absolute deviation, from a histogram over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.spark_io import conf_int, discard, fresh_name, materialize, sized, stored, text_slices, tidy
from txrisk.llm.words import SPACE, Words, find_words, hash_ranges, mix, window_hash

PAIR_SHARE = 2.0**-20
BELOW, ABOVE = 4.5, 3.0    # how far a band goes from the median, in scaled deviations
LEAST_DEVIATION = 0.05
STEP = 0.01                # bin of log perplexity
_WORD = np.uint64((1 << 48) - 1)  # bits of a word's hash
_START = np.uint64(0)      # stands before a text's first word
BUCKET_BYTES = 16 << 20    # of text for each bucket
_ONE = float(1 << 19)      # fixed point of log probabilities: the least, log 1e-12, has 24 bits
RUN_POSTINGS = 1_000_000   # tail bigrams that a scoring task sends at a time
HELD_PAIRS = 1_500_000     # bigrams that a counting task holds
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Model:
    pairs: np.ndarray      # sorted keys of common bigrams
    logs: np.ndarray       # log probability of each, in fixed point

    def log_prob(self, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of each word, and place and key of the words whose
        bigram is in the tail (0 here)."""
        key = _pair_keys(*_pairs_of(h, ptr))
        if len(self.pairs) == 0:
            return np.zeros(len(key), np.int64), np.arange(len(key)), key
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = self.pairs[k] == key
        return np.where(known, self.logs[k], 0), np.flatnonzero(~known), key[~known]


@dataclass
class Fitted:
    model: Model
    tail: DataFrame  # bucket, x (sorted keys), y (minus their logs); grows with the corpus
    buckets: int
    scratch: list    # folders that may go once texts are scored


def _pairs_of(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and the word."""
    after = np.maximum(h & _WORD, np.uint64(1))
    before = np.concatenate([[_START], after[:-1]]).astype(np.uint64)[:len(after)]
    before[ptr[:-1][ptr[:-1] < ptr[1:]]] = _START
    return before, after


def _pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before) + after) >> np.uint64(8)


def _home(x: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bucket of hashes of some bits: equal ranges, so that a bucket's keys lie close."""
    return ((x >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _word_hashes(rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray):
    w = find_words(buf, off)
    h = hash_ranges(buf, w.start, w.end)
    raw = [(x.as_py() or "").encode() for x in rows.column("lang")]
    size = np.array([len(x) for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    salt = np.zeros(len(raw), np.uint64)
    if len(flat):
        some = size > 0
        stop = np.cumsum(size)
        salt[some] = hash_ranges(flat, (stop - size)[some], stop[some])
    return w, mix(h ^ np.repeat(salt, np.diff(w.ptr)))


class _Counter:
    """Counts of bigrams, merged whenever ``limit`` of them wait."""

    def __init__(self, limit: int) -> None:
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.limit = 0, limit

    def add(self, keys: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> bool:
        """Whether different bigrams fill half of the bound, so that they should be sent."""
        self.runs.append((keys, before, after, counts))
        self.waiting += len(counts)
        if self.waiting <= self.limit:
            return False
        self.total()
        return self.waiting > self.limit // 2

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """before, after and count of each different bigram."""
        if not self.waiting:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, before, after, counts = (np.concatenate(x) for x in zip(*self.runs))
        self.runs = []
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        at = order[first]
        self.runs = [(keys[first], before[at], after[at], np.add.reduceat(counts[order], first))]
        self.waiting = len(first)
        return self.runs[0][1:]


def _pack(a: np.ndarray) -> bytes:
    """Differences of a rising array, byte planes apart: compresses well in shuffles."""
    d = np.diff(a, prepend=a[:1] * 0)
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def _planes(a: np.ndarray, width: int = 0) -> bytes:
    """Byte planes of whole numbers; without a width, as many as the greatest needs,
    and their number first."""
    head = b""
    if not width:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head = bytes([width])
    return head + np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(b: bytes, width: int = 0) -> np.ndarray:
    at = 0 if width else 1
    width = width or b[0]
    planes = np.frombuffer(b, np.uint8, offset=at).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _split(home: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket that has any, with the places of its own in their order."""
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(buckets + 1, dtype=np.uint64))
    return [(i, order[x:y]) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)],
                                      [c for c, _ in fields])


RUNS = "bucket int, before binary, after binary, counts binary"
ASKED = "home int, bucket int, keys binary, counts binary"
LEFT = "bucket int, home int, counts binary"
LOGS = "kind int, bucket int, x binary, y binary"


def _runs(counter: _Counter, buckets: int) -> list[tuple]:
    """Bigrams by their first word, which stays together; those of a text's start by the other."""
    before, after, counts = counter.total()
    order = np.lexsort((after, before))
    before, after, counts = before[order], after[order], counts[order]
    home = _home(np.where(before == _START, after, before), 48, buckets)
    return [(i, _pack(before[o]), _planes(after[o], 6), _planes(counts[o])) for i, o in _split(home, buckets)]


def _bigrams(before: bytes, after: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpack(before), _unplanes(after, 6).astype(np.uint64), _unplanes(counts)


def _tally(a: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4 and more than 2, their sum, and how many there are."""
    return [*(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 2).sum()), int(a.sum()), len(a)]


def different_texts(docs: DataFrame) -> DataFrame:
    """lang and text of each different text, once."""
    keyed = docs.select("lang", "text", F.unhex(F.md5(F.concat_ws(
        "\0", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))).alias("_key"))
    copies = sized(materialize(keyed.groupBy("_key").count().where("count > 1").select("_key"), "quality-copies"))
    one = keyed.join(copies, "_key", "left_semi").groupBy("_key").agg(F.first(F.struct("lang", "text")).alias("t"))
    return keyed.join(copies, "_key", "left_anti").select("lang", "text").unionByName(one.select("t.lang", "t.text"))


def fit(docs: DataFrame) -> Fitted:
    """The model of all different texts of ``docs`` (lang, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(conf_int(spark, "spark.sql.shuffle.partitions", 200), -(-size // BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(HELD_PAIRS)
        for rows, buf, off in text_slices(batches):
            w, h = _word_hashes(rows, buf, off)
            before, after = _pairs_of(h, w.ptr)
            if counter.add(_pair_keys(before, after), before, after, np.ones(len(after), np.int64)):
                yield _table(RUNS, _runs(counter, buckets))
                counter = _Counter(HELD_PAIRS)
        yield _table(RUNS, _runs(counter, buckets))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs sorted by bucket: one bucket is held at a time."""
        tally, now, counter = np.zeros(8, "<i8"), None, _Counter(HELD_PAIRS)

        def close() -> pa.RecordBatch:
            before, _, counts = counter.total()
            tally[:] += np.array([*_tally(counts[before != _START]), counts.sum()])  # the last counts all words
            return _table(RUNS, _runs(counter, buckets))

        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "before", "after", "counts"))):
                if bucket != now:
                    if now is not None:
                        yield close()
                    now, counter = bucket, _Counter(HELD_PAIRS)
                before, after, counts = _bigrams(*row)
                counter.add(_pair_keys(before, after), before, after, counts)
        if now is not None:
            yield close()
        yield _table(RUNS, [(None, None, None, tally.tobytes())])

    pairs, pairs_at = stored(different_texts(docs).mapInArrow(tidy(count), RUNS).repartition(buckets, "bucket")
                             .sortWithinPartitions("bucket").mapInArrow(tidy(merge), RUNS), "quality-pairs")
    *tally, words = _added(pairs, 8)
    bigrams = pairs.where("bucket IS NOT NULL")
    least = max(1, int(np.ceil(words * PAIR_SHARE)))
    d = _discounts(tally[:4])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "before", "after", "counts"))):
                before, after, _ = _bigrams(*row)
                own, inv = np.unique(after, return_inverse=True)
                c = np.bincount(inv, before != _START, len(own)).astype(np.int64)
                yield _table(ASKED, [(i, bucket, _pack(own[o]), _planes(c[o]))
                                     for i, o in _split(_home(own, 48, buckets), buckets)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "home", "keys", "counts")))]
        keys = [_unpack(k) for _, _, k, _ in asked]
        own, inv = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        left = np.zeros(len(own), np.int64)  # different words before each word
        np.add.at(left, inv, np.concatenate([np.zeros(0, np.int64), *(_unplanes(c) for *_, c in asked)]))
        cut = np.cumsum([0, *map(len, keys)])
        yield _table(LEFT, [*((b, home, _planes(left[inv[x:y]])) for (b, home, *_), x, y in zip(asked, cut[:-1], cut[1:])),
                            (None, None, np.array(_tally(left), "<i8").tobytes())])

    left, left_at = stored(bigrams.mapInArrow(tidy(ask), ASKED).repartition(buckets, "home").mapInArrow(tidy(answer), LEFT),
                           "quality-left")
    *few, more, seen, types = _added(left, 7)
    low = _discounts(few)
    # no discount is above its count, so what they take adds up from how many words have which count
    taken = low[1] * few[0] + low[2] * few[1] + low[3] * more
    floor, seen = taken / (types + 1), max(seen, 1)

    def finish(known: pa.Table, sums: pa.Table) -> pa.Table:
        before, after, counts = _bigrams(*(known.column(c)[0].as_py() for c in ("before", "after", "counts")))
        own, inv = np.unique(after, return_inverse=True)
        n = np.zeros(len(own), np.int64)
        of_home = dict(zip(sums.column("home").to_pylist(), sums.column("counts").to_pylist()))
        for i, o in _split(_home(own, 48, buckets), buckets):
            n[o] = _unplanes(of_home[i])
        unigram = ((np.maximum(n - low[np.minimum(n, 3)], 0) + floor) / seen)[inv]
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        size = np.diff(np.append(first, len(before)))
        cost = d[np.minimum(counts, 3)]
        total = np.repeat(np.add.reduceat(counts, first), size)
        backoff = np.maximum(np.repeat(np.add.reduceat(cost, first), size) / total, 1e-9)
        p = np.where(before == _START, unigram, np.maximum(counts - cost, 0) / total + backoff * unigram)
        log = np.round(np.log(np.maximum(p, 1e-12)) * _ONE).astype(np.int64)
        key = _pair_keys(before, after)
        order = np.argsort(key)
        key, log, often = key[order], log[order], counts[order] >= least
        out = [(0, None, _pack(key[often]), _planes(-log[often], 3))]
        key, log = key[~often], log[~often]
        out += [(4, i, _pack(key[o]), _planes(-log[o], 3)) for i, o in _split(_home(key, 56, buckets), buckets)]
        return pa.Table.from_batches([_table(LOGS, out)])

    logs, logs_at = stored(bigrams.groupBy("bucket").cogroup(left.where("bucket IS NOT NULL").groupBy("bucket"))
                           .applyInArrow(finish, LOGS), "quality-logs")
    discard(spark, pairs_at, left_at)
    common = logs.where("kind = 0").select("x", "y").collect()  # bounded by PAIR_SHARE
    keys = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["x"]) for r in common)])
    values = np.concatenate([np.zeros(0, np.int64), *(-_unplanes(r["y"], 3) for r in common)])
    order = np.argsort(keys)
    return Fitted(Model(keys[order], values[order]), logs.where("kind = 4").select("bucket", "x", "y"), buckets,
                  [logs_at])


def _added(table: DataFrame, size: int) -> list[int]:
    """Sum of the tallies of ``size`` numbers, one of each task (none for an empty table)."""
    rows = table.where("bucket IS NULL").select("counts").collect()
    return np.sum([np.zeros(size, "<i8"), *(np.frombuffer(r["counts"], "<i8") for r in rows)], axis=0).tolist()


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many keys have counts 1 to 4."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 1.0, 2.0, 3.0])


def _repeat_words(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Words of each text in windows of three that the text holds twice or more."""
    n = np.diff(ptr)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    cover = np.zeros(len(h) + 1, bool)
    inside = np.flatnonzero(text[2:] == text[:-2])
    if len(inside):
        key = mix(window_hash(h, 3)[inside] + (text[inside] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = inside[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        for k in range(3):
            cover[twice + k] = True
    upto = np.concatenate([[0], np.cumsum(cover)])
    return np.diff(upto[ptr])


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_rules(rows: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, w: Words, h: np.ndarray) -> dict:
    """The columns of SCORES for texts with words ``w`` of hashes ``h``."""
    n = np.diff(w.ptr)
    chars = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & ~SPACE[buf])])
    symbols = np.searchsorted(np.flatnonzero(SYMBOL[buf]), off)
    repeat = _repeat_words(h, w.ptr)
    dup = np.array([_dup_lines(buf[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])], np.int64)
    return {"doc_id": rows.column("doc_id"), "lang": rows.column("lang"), "n_words": n, "word_chars": np.diff(chars[off]),
            "n_symbols": np.diff(symbols), "n_dup_lines": dup, "n_repeat_words": repeat,
            "base_failed": (n < 50) | (100 * repeat > 50 * n)}


SCORES = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean")
POSTINGS = "bucket int, keys binary, places binary, counts binary"
SCORED = pa.schema([("slice", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()),
                    *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words")],
                    ("base_failed", pa.bool_()), ("log_sum", pa.int64()), ("bucket", pa.int32()),
                    ("keys", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])


def _batch(**columns) -> pa.RecordBatch:
    """A batch of SCORED rows; columns that are not given are null."""
    n = len(columns["slice"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCORED],
        schema=SCORED)


def _postings(slice_id: int, places: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: rising keys, each with the texts that hold it and how often."""
    home = _home(keys, 56, buckets)
    order = np.lexsort((places, keys, home))
    home, keys, places = home[order], keys[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    home, keys, places = home[first], keys[first], places[first]
    cut = np.searchsorted(home, np.arange(buckets + 1, dtype=np.uint64))
    some = [(i, slice(x, y)) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
    return _batch(slice=[slice_id] * len(some), bucket=[i for i, _ in some], keys=[_pack(keys[o]) for _, o in some],
                  places=[_planes(places[o]) for _, o in some], counts=[_planes(counts[o]) for _, o in some])


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """The base rules and the log perplexity of each text (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)
    buckets = fitted.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slice_id = TaskContext.get().partitionId() << 32
        place, waiting, held = 0, 0, []
        for rows, buf, off in text_slices(batches):
            w, h = _word_hashes(rows, buf, off)
            log, at, key = m.log_prob(h, w.ptr)
            lp = np.concatenate([[0], np.cumsum(log)])
            n = np.diff(w.ptr)
            yield _batch(slice=np.full(len(n), slice_id), place=np.arange(place, place + len(n)),
                         **base_rules(rows, buf, off, w, h), log_sum=np.diff(lp[w.ptr]))
            if len(at):
                held.append((np.searchsorted(w.ptr, at, side="right") - 1 + place, key))
            place, waiting = place + len(n), waiting + len(at)
            if waiting > RUN_POSTINGS:
                yield _postings(slice_id, *map(np.concatenate, zip(*held)), buckets)
                slice_id, place, waiting, held = slice_id + 1, 0, 0, []
        if held:
            yield _postings(slice_id, *map(np.concatenate, zip(*held)), buckets)

    columns = ", ".join(["slice long, place long", SCORES, "log_sum long", POSTINGS])
    both, scored_at = stored(docs.mapInArrow(tidy(run), columns), "quality-scored")
    fitted.scratch.append(scored_at)
    tail = tail_sums(both.where("bucket IS NOT NULL").select("slice", *(c.split()[0] for c in POSTINGS.split(", "))),
                     fitted)
    whole = F.col("log_sum") + F.coalesce("tail_sum", F.lit(0))
    return (both.where("bucket IS NULL").join(tail, ["slice", "place"], "left")
            .select(*(c.split()[0] for c in SCORES.split(", ")),
                    F.when(F.col("n_words") > 0, -whole / F.lit(_ONE) / F.col("n_words")).alias("log_ppl")))


def tail_sums(postings: DataFrame, fitted: Fitted) -> DataFrame:
    """slice, place, tail_sum: what a text's tail bigrams add to its log probability."""
    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x.as_py()) for x in known.column("x"))])
        logs = np.concatenate([np.zeros(0, np.int64), *(-_unplanes(y.as_py(), 3) for y in known.column("y"))])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        slices, places, sums = [], [], []
        for s, k, p, c in zip(*(asked.column(x) for x in ("slice", "keys", "places", "counts"))):
            log = logs[np.searchsorted(keys, _unpack(k.as_py()))] * _unplanes(c.as_py())
            own, inv = np.unique(_unplanes(p.as_py()), return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, inv, log)
            slices.append(s)
            places.append(_planes(own))
            sums.append(total.astype("<i8").tobytes())
        return pa.table({"slice": pa.array([s.as_py() for s in slices], pa.int64()),
                         "places": pa.array(places, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def add(answers: pa.Table) -> pa.Table:
        places = np.concatenate([_unplanes(p.as_py()) for p in answers.column("places")])
        sums = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in answers.column("sums")])
        own, inv = np.unique(places, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, inv, sums)
        return pa.table({"slice": pa.array([answers.column("slice")[0].as_py()] * len(own), pa.int64()),
                         "place": pa.array(own, pa.int64()), "tail_sum": pa.array(total, pa.int64())})

    return (postings.groupBy("bucket").cogroup(fitted.tail.groupBy("bucket"))
            .applyInArrow(look_up, "slice long, places binary, sums binary")
            .groupBy("slice").applyInArrow(add, "slice long, place long, tail_sum long"))


def bands(scores: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """lang, lower, upper of log perplexity, from texts that pass the base rules."""
    bins = (scores.where(~F.col("base_failed")).withColumn("lang", F.coalesce("lang", F.lit("")))
            .groupBy("lang", F.round(F.col("log_ppl") / STEP).alias("v")).agg(F.count(F.lit(1)).alias("n")))

    def median(hist: DataFrame, v: str, name: str) -> DataFrame:
        w = Window.partitionBy("lang")
        up = hist.withColumn("_up", F.sum("n").over(w.orderBy(v))).withColumn("_all", F.sum("n").over(w))
        return up.where(2 * F.col("_up") >= F.col("_all")).groupBy("lang").agg(F.min(v).alias(name))

    mid = median(bins, "v", "mid")
    off = bins.join(mid, "lang").withColumn("off", F.abs(F.col("v") - F.col("mid")))
    dev = median(off.groupBy("lang", "off").agg(F.sum("n").alias("n")), "off", "dev")
    unit = F.greatest(1.4826 * F.col("dev") * STEP, F.lit(LEAST_DEVIATION))
    return mid.join(dev, "lang").select("lang", (F.col("mid") * STEP - F.lit(below) * unit).alias("lower"),
                                        (F.col("mid") * STEP + F.lit(above) * unit).alias("upper"))


def judge_quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, then lang, log_ppl, lower and upper, for each row.

    Words are runs without white space.  A null text has no words and fails, a
    null language is a language of its own, a null doc_id stays null, repeated
    rows are judged and counted each, an empty table gives no rows; other
    columns are not read.  Texts of any length are read whole.
    """
    from txrisk.llm.bigram_passes import score_all
    slim = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    scored, scratch = score_all(slim)
    scores = materialize(scored, "quality-scores")
    discard(docs.sparkSession, *scratch)
    limits = sized(materialize(bands(scores, below, above), "quality-bands"))
    limits = limits.withColumnRenamed("lang", "_lang")
    ok = ~F.col("base_failed") & F.col("log_ppl").between(F.col("lower"), F.col("upper"))
    return (scores.join(limits, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.coalesce(ok, F.lit(False)).alias("kept"), "lang", "log_ppl", "lower", "upper"))


def keep_good(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    A null text has no words and goes; an empty table gives no rows.  Rows are
    matched by doc_id; if an id has several texts, all of them stay
    where one is kept.  Rows with a null id are dropped with the rejected only
    if all rows with null ids are rejected.
    """
    gone_id = fresh_name(docs.columns, "gone_id")
    kept = materialize(judge_quality(docs, below, above).groupBy("doc_id").agg(F.max("kept").alias("kept")), "quality-kept")
    gone = sized(kept.where("NOT kept").select(F.col("doc_id").alias(gone_id)))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
