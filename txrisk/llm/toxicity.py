"""Operator 1: toxicity by non-negative positive-unlabelled learning.

Linear classifiers in numpy learn from confirmed toxic texts and from
unlabelled texts.  With class prior p and logistic loss L, the risk is

    p E_pos[L(z)] + max(0, E_unl[L(-z)] - p E_pos[L(-z)]),

the second part being the estimated risk of the clean texts; where it falls
below zero the step goes the other way, so that the model does not learn the
unlabelled texts by heart.  Features are byte n-grams of lower-cased words,
hashed; the most telling ones are chosen by their document frequencies in the
two samples.  The fit reads bounded samples (``Settings``), scoring every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import materialize, text_slices
from txrisk.llm.words import LOWER, SPACE

FOLDS = 5  # rows whose crc32(doc_id) has remainder 0 are held out


@dataclass(frozen=True)
class Settings:
    positives: int = 3000      # bound of the sample of confirmed toxic texts
    unlabelled: int = 9000     # bound of the sample of unlabelled texts
    features: int = 512        # most features chosen
    least_z: float = 6.0       # of the difference between the samples
    least_lift: float = 3.0    # frequency in toxic texts over that in unlabelled ones
    grams: tuple = (4, 6, 8)   # bytes; white space before a word counts as one
    bits: int = 20             # of the feature hash
    members: int = 4           # classifiers, each on its own part of the unlabelled texts
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 17


def fold(doc_id: Column) -> Column:
    """Remainder that decides the fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def gram_hashes(buf: np.ndarray, off: np.ndarray, grams: tuple, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: positions where one begins, and its feature."""
    if len(buf) < 2:
        return
    low = LOWER[buf]
    space = SPACE[buf]
    low = np.where(space, np.uint8(0x20), low)
    n = len(buf)
    # first position after i where a word ends (white space or end of text)
    stop = np.where(space, np.arange(n, dtype=np.int32), np.int32(n))
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    stop_next = np.append(stop[1:], np.int32(n))
    stop_next[edge - 1] = edge  # a text ends: nothing runs into the next
    stop_next = np.minimum.accumulate(stop_next[::-1])[::-1]
    h = low.astype(np.uint32) * np.uint32(0x9E3779B1)
    for k in range(1, max(grams)):
        if k >= n:
            break
        h = (h[:n - k] * np.uint32(0x01000193)) ^ (low[k:].astype(np.uint32) * np.uint32(0x85EBCA6B))
        if k + 1 in grams:
            at = np.flatnonzero(stop_next[:n - k] >= np.arange(k + 1, n + 1, dtype=np.int32))
            f = h[at] + np.uint32(k)
            f = (f ^ (f >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            f ^= f >> np.uint32(13)
            yield at, (f >> np.uint32(32 - bits)).astype(np.int32)


def _scale(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def sample_ids(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, positive: the bounded samples, the least by a hash of the id."""
    train = fold(F.col("doc_id")) != 0
    order = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    pos = (labels.where(train & (F.col("toxic") == 1) & F.col("doc_id").isNotNull())
           .select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(order, "doc_id").limit(s.positives))
    unl = (docs.where(train & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
           .orderBy(order, "doc_id").limit(s.unlabelled))
    return pos.withColumn("positive", F.lit(True)).union(unl.withColumn("positive", F.lit(False)))


def class_prior(labels: DataFrame) -> float:
    """Share of toxic rows among labelled rows outside the held-out fold."""
    r = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).agg(F.avg("toxic").alias("p")).first()
    return float(r["p"] or 0.0)


def choose_features(sample: DataFrame, s: Settings) -> np.ndarray:
    """The features that are most telling of toxic texts by document frequency."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, 1 << s.bits), np.int64)
        for rows, buf, off in text_slices(batches):
            side = rows.column("positive").to_numpy(zero_copy_only=False).astype(int)
            for at, f in gram_hashes(buf, off, s.grams, s.bits):
                ptr = np.searchsorted(at, off)
                for d, (a, b) in enumerate(zip(ptr[:-1], ptr[1:])):
                    df[side[d], np.unique(f[a:b])] += 1
        some = np.flatnonzero(df.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[1, some]), pa.array(df[0, some])],
                                         ["f", "p", "u"])

    sides = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = max(sides.get(True, 0), 1), max(sides.get(False, 0), 1)
    p, u = F.col("p") / n_p, F.col("u") / n_u
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    top = (sample.mapInArrow(frequencies, "f long, p long, u long").groupBy("f")
           .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
           .where((z >= s.least_z) & (p >= s.least_lift * u))
           .orderBy(z.desc(), "f").limit(s.features).select("f").collect())
    return np.array(sorted(r["f"] for r in top), np.int64)


def feature_rows(sample: DataFrame, chosen: np.ndarray, s: Settings) -> DataFrame:
    """positive, x (float16 bytes): the chosen features of each sampled text."""
    place = np.full(1 << s.bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("positive"),
                 pa.array([_scale(c).astype(np.float16).tobytes() for c in _counts(buf, off, place, len(chosen), s)],
                          pa.binary())], ["doc_id", "positive", "x"])

    return sample.mapInArrow(run, "doc_id long, positive boolean, x binary")


def _counts(buf: np.ndarray, off: np.ndarray, place: np.ndarray, width: int, s: Settings) -> np.ndarray:
    """Counts of the chosen features in each text."""
    out = np.zeros((len(off) - 1) * width, np.float64)
    for at, f in gram_hashes(buf, off, s.grams, s.bits):
        k = place[f]
        hit = np.flatnonzero(k >= 0)
        doc = np.searchsorted(off, at[hit], side="right") - 1
        out += np.bincount(doc * width + k[hit], minlength=len(out))
    return out.reshape(len(off) - 1, width)


@dataclass
class Linear:
    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def fit_pu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, s: Settings, seed: int) -> tuple[np.ndarray, float]:
    """One classifier by the non-negative risk, full-batch Adam."""
    spread = np.maximum(x_unl.std(0), 0.05)
    xp, xu = x_pos / spread, x_unl / spread
    w, m, v = np.zeros(xp.shape[1] + 1), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    w[:-1] = rng.normal(0, 1e-3, len(w) - 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def back(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(g @ x, g.sum()) / len(x)

    for step in range(1, s.steps + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        as_clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_clean = back(xu, sig(zu)) - prior * back(xp, sig(zp))
        g = prior * back(xp, sig(zp) - 1) + g_clean if as_clean >= 0 else -g_clean
        g[:-1] += s.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1] / spread, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Linear:
    """The mean of the classifiers; without a confirmed toxic text it scores the prior."""
    ids = materialize(sample_ids(docs, labels, s), "toxic-ids")  # bounded by the settings
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
                         .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "positive"]), "toxic-sample")
    chosen = choose_features(sample, s)
    prior = min(max(class_prior(labels), 1e-3), 0.9)
    rows = feature_rows(sample, chosen, s).collect()
    rows.sort(key=lambda r: (r["positive"], r["doc_id"]))
    x = {side: np.array([np.frombuffer(r["x"], np.float16) for r in rows if r["positive"] == side], np.float32)
         for side in (True, False)}
    if not len(chosen) or not len(x[True]) or not len(x[False]):
        return Linear(chosen[:0], np.zeros(0), float(np.log(prior / (1 - prior))))
    parts = [x[False][k::s.members] for k in range(s.members)]
    fits = [fit_pu(x[True], u, prior, s, s.seed + k) for k, u in enumerate(parts) if len(u)]
    return Linear(chosen, np.mean([w for w, _ in fits], 0), float(np.mean([b for _, b in fits])))


def score_toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    ``labels`` has doc_id and toxic; rows of the held-out fold (remainder 0 of
    crc32 of the id) are not learned from, nor are other columns.  A null text
    is scored as an empty one, a null id belongs to the fold of the empty text
    and is never sampled, repeated rows are scored each, empty ``docs`` give no
    rows, and without confirmed toxic texts every score is the prior.
    """
    model = fit(docs, labels, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `features` weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = np.full(1 << s.bits, -1, np.int32)
        place[m.chosen] = np.arange(len(m.chosen))
        for rows, buf, off in text_slices(batches):
            p = m.score(_scale(_counts(buf, off, place, len(m.chosen), s)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(p, pa.float64()),
                 pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        (fold(F.col("doc_id")) == 0).alias("held_out"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))
