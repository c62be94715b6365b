"""Distributed scans over a total order (§4.2 of the survey).

A window without ``partitionBy`` sends every row to one task.  Every
"global order" operator here is built from one pattern instead:

1. cut the order key into P equal-count ranges (``approxQuantile``; P is
   derived from the row count and capped, so the range table is bounded);
2. run the window inside each range (``partitionBy(range)``);
3. aggregate one row per range (<= P rows), prefix-sum it, and join the
   carried totals back (broadcast only when P fits the checked bound).

The result is exact for any cut, so range boundaries only affect balance.
A hot key (sender, slice) is split the same way: the window runs per
``(key, range)`` and the per-key prefix runs over at most P range rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ROWS_PER_RANGE = 2_000_000
TIME_ROWS_PER_RANGE = 500_000  # of whole transactions, which a task sorts: some hundred MB
MIN_ROWS_PER_RANGE = 250_000  # below this a range is not worth its own task
MAX_RANGES = 50_000
BROADCAST_RANGE_ROWS = 200_000  # a range table above this is joined by shuffle


@dataclass(frozen=True)
class Ranges:
    """Equal-count cut of one numeric column (``splits`` are Bucketizer splits).

    ``heavy`` lists key values that alone hold more than a range's worth of
    rows (e.g. one millisecond holding a third of the data).  Each gets its own
    range [h, h + 1) and is cut further by the long ``tiebreak`` column at
    ``heavy[i][1]``; the range id is then ``base * stride + sub``, still
    increasing with (key, tiebreak).
    """

    column: str
    splits: tuple
    tiebreak: str | None = None
    heavy: tuple = ()

    @property
    def stride(self) -> int:
        return max((len(t) + 1 for _, t in self.heavy), default=1)

    @property
    def n(self) -> int:
        return (len(self.splits) - 1) * self.stride

    def deal(self, df: DataFrame, rng: str = "_rng") -> DataFrame:
        """``df`` with one task for each range (a crowded key's parts: by hash), whatever the session's partitions."""
        return df.repartition(rng) if self.heavy else df.repartitionById(self.n, F.col(rng))

    def assign(self, df: DataFrame, out: str = "_rng", src: str | None = None,
               tiebreak_src: str | None = None) -> DataFrame:
        """Add the range id (increasing with the key, then the tiebreak)."""
        if self.n == 1:
            return df.withColumn(out, F.lit(0))
        b = Bucketizer(splits=list(self.splits), inputCol=src or self.column, outputCol=out,
                       handleInvalid="keep")
        d = b.transform(df).withColumn(out, F.col(out).cast("int"))
        if not self.heavy:
            return d
        key, tie = F.col(src or self.column), F.col(tiebreak_src or self.tiebreak)
        sub = F.lit(0)
        for value, cuts in reversed(self.heavy):
            sub = F.when(key == F.lit(value), _search(tie, list(cuts), 0, len(cuts))).otherwise(sub)
        return d.withColumn(out, F.col(out) * F.lit(self.stride) + sub)


def _search(x: Column, cuts: list, lo: int, hi: int) -> Column:
    """Number of cuts <= x as a balanced CASE tree (depth log2 of the cut count)."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(x >= F.lit(cuts[mid - 1]), _search(x, cuts, mid, hi)).otherwise(_search(x, cuts, lo, mid - 1))


def plan_ranges(df: DataFrame, column: str, rows_per_range: int = DEFAULT_ROWS_PER_RANGE,
                max_ranges: int = MAX_RANGES, n_rows: int | None = None,
                min_rows_per_range: int = MIN_ROWS_PER_RANGE, tiebreak: str | None = None,
                max_sub: int = 1024) -> Ranges:
    """Equal-count ranges of ``column``: P = ceil(N / rows_per_range), capped,
    and at least the default parallelism while ranges keep >= min_rows_per_range.

    Costs one count and one approxQuantile pass over a single pruned column;
    only P-1 boundary values come back to the driver.  With ``tiebreak`` (a
    long column continuing the order), a key value that repeats among the
    boundaries is isolated and cut again by the tiebreak (one grouped
    percentile_approx job), so even one hot key value is spread over tasks.
    """
    n = df.count() if n_rows is None else n_rows
    p = math.ceil(n / max(1, rows_per_range))
    if rows_per_range >= min_rows_per_range:
        par = df.sparkSession.sparkContext.defaultParallelism
        p = max(p, min(par, n // min_rows_per_range))
    p = int(min(max_ranges, max(1, p)))
    if p <= 1:
        return Ranges(column, (-math.inf, math.inf))
    probs = [i / p for i in range(1, p)]
    qs = [float(q) for q in df.approxQuantile(column, probs, 1.0 / (4 * p))
          if q is not None and not math.isnan(q)]
    inner = set(qs)
    heavy = ()
    numeric = ("byte", "short", "integer", "long")
    if tiebreak is not None and df.schema[tiebreak].dataType.typeName() in numeric:
        rep = sorted(v for v in inner if qs.count(v) >= 2)  # holds >= ~one range of rows
        if rep:
            cnt = dict(df.where(F.col(column).isin(rep)).groupBy(column).count().collect())
            subs = {v: min(max_sub, max(2, math.ceil(cnt.get(v, 0) / rows_per_range))) for v in rep}
            k = max(subs.values())
            cuts = df.where(F.col(column).isin(rep)).groupBy(column).agg(
                F.percentile_approx(tiebreak, [i / k for i in range(1, k)], 4 * k).alias("_c")).collect()
            hv = []
            for row in cuts:
                v, c = float(row[0]), sorted(set(row["_c"] or []))
                step = max(1, len(c) // max(1, subs[v] - 1))
                hv.append((v, tuple(c[step - 1::step][: subs[v] - 1]) if len(c) > subs[v] - 1 else tuple(c)))
                inner.add(math.nextafter(v, math.inf) if not float(v).is_integer() else v + 1.0)
            heavy = tuple(sorted(hv))
    return Ranges(column, tuple([-math.inf] + sorted(inner) + [math.inf]), tiebreak, heavy)


def _maybe_broadcast(small: DataFrame, n_ranges: int) -> DataFrame:
    return F.broadcast(small) if n_ranges <= BROADCAST_RANGE_ROWS else small


def more_tasks(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``n`` tasks, if the session's shuffles have fewer: rows of a task
    don't grow with the table."""
    have = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if n > have else df


def running_totals(df: DataFrame, keys: list[str], rng: str, n_ranges: int, order: list[Column],
                   sums: dict[str, tuple[Column, bool]], descending: bool = False,
                   totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums over ``order`` within ``keys``, split by range column ``rng``.

    ``sums``: name -> (expression, inclusive).  Inclusive frames end at the
    current row, exclusive ones at the row before.  ``descending`` means the
    range ids run opposite to ``order`` (e.g. scores sorted high to low).
    Rows with equal order values need a tiebreak in ``order`` for determinism.
    ``totals`` (column -> name in ``sums``) adds whole sums per key, from the
    same window and the same range table: no second pass, no further join.
    """
    totals = totals or {}
    tmp = {n: f"__v_{n}" for n in sums}
    d = df.withColumns({tmp[n]: e for n, (e, _) in sums.items()})
    w_in = Window.partitionBy(*keys, rng).orderBy(*order)
    cols = {}
    for n, (_, inclusive) in sums.items():
        frame = w_in.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        cols[n] = F.coalesce(F.sum(tmp[n]).over(frame), F.lit(0).cast(d.schema[tmp[n]].dataType))
    if n_ranges == 1:
        whole = Window.partitionBy(*keys, rng)
        cols |= {t: F.sum(tmp[n]).over(whole) for t, n in totals.items()}
        return d.withColumns(cols).drop(*tmp.values())
    # one row per (key, range), then a prefix over at most P rows per key
    tot = d.groupBy(*keys, rng).agg(*[F.sum(tmp[n]).alias(tmp[n]) for n in sums])
    o = F.col(rng).desc() if descending else F.col(rng).asc()
    w_k = Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    w_all = w_k.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_key = more_tasks(tot, n_ranges, *keys) if keys else tot
    carried = per_key.select(*keys, rng, *[
        F.coalesce(F.sum(tmp[n]).over(w_k), F.lit(0).cast(tot.schema[tmp[n]].dataType))
         .alias(f"__c_{n}") for n in sums],
        *[F.sum(tmp[n]).over(w_all).alias(t) for t, n in totals.items()])
    if not keys:
        carried = _maybe_broadcast(carried, n_ranges)
    out = more_tasks(d, n_ranges, *keys, rng).withColumns(cols).join(carried, on=[*keys, rng], how="inner")
    return out.withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in sums}) \
              .drop(*tmp.values(), *[f"__c_{n}" for n in sums])


def with_row_index(df: DataFrame, ranges: Ranges, order: list[str], out: str = "row_idx") -> DataFrame:
    """W9 for any table: global 0-based index in ``order`` (first column is the ranged key)."""
    d = ranges.assign(df, out="_rng", src=order[0])
    d = running_totals(d, [], "_rng", ranges.n, [F.col(c) for c in order],
                       {out: (F.lit(1).cast("bigint"), False)})
    return d.drop("_rng")
