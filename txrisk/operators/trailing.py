"""Trailing time windows over the total order (W1, W4, W9, W12), payload carried.

Rows are cut in ranges of the order (``scan.plan_ranges``) and each range is
read once, in order, by a stream that holds the last ``lookback_ms`` only.
What a range needs of the ranges before it is a *halo*: one weighted row for each
millisecond (for the median: millisecond and value) of the look-back, so at
most 60 000 rows for a minute, however many transactions a burst holds.  Row
numbers and the last time before a range come from one row per range.  The
rows' other columns travel along: nothing is joined back by key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.scan import Ranges
from txrisk.session import ship_package

BLOCK = 512


class ValueCounts:
    """A sorted multiset as blocks of (value, count); order statistics by block sums."""

    def __init__(self) -> None:
        self.values, self.counts, self.sums, self.size = [[]], [[]], [0], 0

    def add(self, x: float, n: int) -> None:
        """``n`` more of x (fewer, if negative)."""
        k = 0
        while k < len(self.values) - 1 and (not self.values[k] or self.values[k][-1] < x):
            k += 1
        vals, cnts = self.values[k], self.counts[k]
        i = bisect_left(vals, x)
        if i < len(vals) and vals[i] == x:
            cnts[i] += n
            if cnts[i] == 0:
                del vals[i], cnts[i]
        else:
            vals.insert(i, x)
            cnts.insert(i, n)
        self.sums[k] += n
        self.size += n
        if len(vals) > BLOCK:
            half = len(vals) // 2
            self.values[k:k + 1] = [vals[:half], vals[half:]]
            self.counts[k:k + 1] = [cnts[:half], cnts[half:]]
            self.sums[k:k + 1] = [sum(cnts[:half]), sum(cnts[half:])]
        elif not vals and len(self.values) > 1:
            del self.values[k], self.counts[k], self.sums[k]

    def at(self, rank: int) -> float:
        for vals, cnts, total in zip(self.values, self.counts, self.sums):
            if rank < total:
                for v, c in zip(vals, cnts):
                    if rank < c:
                        return v
                    rank -= c
            rank -= total
        raise IndexError(rank)

    def median(self) -> float | None:
        if self.size == 0:
            return None
        a = self.at((self.size - 1) // 2)
        return a if self.size % 2 else (a + self.at(self.size // 2)) / 2


class _Range:
    """Where a stream stands in one range."""

    def __init__(self, offset: int, last: int | None, lookback: int, median: bool):
        self.rows, self.last, self.lookback = offset, last, lookback
        self.times, self.before = np.zeros(0, np.int64), np.zeros(0, np.int64)  # distinct ms, weight before each
        self.total = 0
        self.window = ValueCounts() if median else None
        self.held: list = []  # (ms, value, weight) of the window, oldest first
        self.gone = 0

    def step(self, t: np.ndarray, data: np.ndarray, w: np.ndarray) -> tuple:
        """row_idx, prev_ts (and whether there is one) and pressure of rows in order."""
        before = self.total + np.cumsum(w) - w
        times, weights = np.concatenate([self.times, t]), np.concatenate([self.before, before])
        start = np.searchsorted(times, t - self.lookback, side="left")
        pressure = before - weights[start]
        index = self.rows + np.cumsum(data) - data
        has_prev = np.ones(len(t), bool)
        has_prev[0] = self.last is not None
        prev = np.concatenate([[self.last if self.last is not None else 0], t[:-1]])
        self.total, self.rows, self.last = int(before[-1] + w[-1]), int(index[-1] + data[-1]), int(t[-1])
        keep = np.concatenate([[True], times[1:] != times[:-1]]) & (times >= self.last - self.lookback)
        self.times, self.before = times[keep], weights[keep]
        return index, prev, has_prev, pressure

    def medians(self, t: list, data: list, w: list, values: list) -> list:
        """Median of the values in the window before each row; None where it is empty."""
        out = []
        for at, is_row, weight, x in zip(t, data, w, values):
            while self.gone < len(self.held) and self.held[self.gone][0] < at - self.lookback:
                _, old, n = self.held[self.gone]
                self.window.add(old, -n)
                self.gone += 1
            if self.gone > 65536:
                del self.held[:self.gone]
                self.gone = 0
            out.append(self.window.median() if is_row else None)
            if x is not None and x == x:
                self.window.add(x, weight)
                self.held.append((at, x, weight))
        return out


def _halo(d: DataFrame, ranges: Ranges, ts: str, by: list[str], lookback_ms: int) -> DataFrame:
    """_rng, ts (and ``by``), _w: weighted rows of earlier ranges that a range can look back on."""
    h = d.groupBy("_rng", ts, *by).agg(F.count(F.lit(1)).alias("_w"))
    base = Ranges(ranges.column, ranges.splits)
    h = base.assign(h.withColumn("_until", F.col(ts) + lookback_ms), "_last", "_until")
    stride = ranges.stride
    h = h.withColumn("_base", F.explode(F.sequence(F.floor(F.col("_rng") / stride).cast("int"), F.col("_last"))))
    heavy = base.assign(d.sparkSession.createDataFrame([(float(v), len(c)) for v, c in ranges.heavy], "_v double, _n int"),
                        "_base", "_v").collect() if ranges.heavy else []
    subs = F.array(F.lit(0))
    for r in heavy:  # the parts of one crowded millisecond
        subs = F.when(F.col("_base") == r["_base"], F.array(*[F.lit(i) for i in range(r["_n"] + 1)])).otherwise(subs)
    h = h.withColumn("_sub", F.explode(subs)).withColumn("_to", F.col("_base") * stride + F.col("_sub"))
    return h.where("_to > _rng").select(F.col("_to").cast("int").alias("_rng"), ts, *by, "_w")


def time_order(tx: DataFrame, ranges: Ranges, ts: str = "timestamp_ms", key: str = "tx_id",
               lookback_ms: int = 60_000, median_of: str | None = None) -> DataFrame:
    """``tx`` with row_idx (W9: 0-based place in the order (ts, key)), prev_ts (W1 input:
    time of the row before, NULL for the first) and pressure (W4: rows before this one
    that are at most ``lookback_ms`` older).  With ``median_of``, also trailing_median (W12):
    the median of that column over the same rows, NULL if there are none.

    All other columns are kept.  ``ts`` must not be NULL.
    """
    ship_package(tx.sparkSession)
    value = [] if median_of is None else ["_value"]
    d = ranges.assign(tx, "_rng", ts, key)
    if value:
        d = d.withColumn("_value", F.col(median_of).cast("double"))
    offsets, lasts = {}, {}
    if ranges.n > 1:  # one row per range
        seen, last = 0, None
        for r in d.groupBy("_rng").agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("t")).orderBy("_rng").collect():
            offsets[r["_rng"]], lasts[r["_rng"]] = seen, last
            seen, last = seen + r["n"], r["t"]
    rows = d.withColumn("_w", F.lit(1).cast("bigint")).withColumn("_data", F.lit(1))
    if ranges.n > 1:
        halo = _halo(d, ranges, ts, value, lookback_ms).withColumn("_data", F.lit(0))
        rows = rows.unionByName(halo, allowMissingColumns=True)
    extra = [T.StructField("row_idx", T.LongType()), T.StructField("prev_ts", T.LongType()),
             T.StructField("pressure", T.LongType())]
    if value:
        extra.append(T.StructField("trailing_median", T.DoubleType()))
    new = {f.name for f in extra}
    keep = [f for f in tx.schema.fields if f.name not in new]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rng, t, w, data = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                               for c in ("_rng", ts, "_w", "_data"))
            cuts = [0, *(np.flatnonzero(rng[1:] != rng[:-1]) + 1).tolist(), len(rng)]
            parts, mids = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if int(rng[a]) != now:
                    now = int(rng[a])
                    state = _Range(offsets.get(now, 0), lasts.get(now), lookback_ms, bool(value))
                if value:
                    mids += state.medians(t[a:b].tolist(), data[a:b].tolist(), w[a:b].tolist(),
                                          batch.column("_value").slice(a, b - a).to_pylist())
                parts.append(state.step(t[a:b], data[a:b], w[a:b]))
            index, prev, has_prev, pressure = (np.concatenate(x) for x in zip(*parts))
            columns = [batch.column(f.name) for f in keep] + [
                pa.array(index, pa.int64()), pa.array(prev, pa.int64(), mask=~has_prev), pa.array(pressure, pa.int64())]
            if value:
                columns.append(pa.array(mids, pa.float64()))
            out = pa.RecordBatch.from_arrays(columns, [f.name for f in [*keep, *extra]])
            yield out.filter(pa.array(data == 1))

    return (ranges.deal(rows).sortWithinPartitions("_rng", ts, "_data", key)
            .mapInArrow(scan, T.StructType([*keep, *extra])))


def tip_above_trailing_median(tx: DataFrame, ranges: Ranges, tip: str, factor: float = 2.0,
                              window_ms: int = 60_000, key: str = "tx_id") -> DataFrame:
    """``key``, n_trailing, trailing_median and high_tip: whether the tip is more than
    ``factor`` times the median tip of the ``window_ms`` before (no row before: not high)."""
    t = time_order(tx, ranges, key=key, lookback_ms=window_ms, median_of=tip)
    return t.select(key, F.col("pressure").alias("n_trailing"), "trailing_median",
                    F.coalesce(F.col(tip).cast("double") > F.lit(factor) * F.col("trailing_median"), F.lit(False))
                    .alias("high_tip"))
