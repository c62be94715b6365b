"""Exact percentiles by refining histograms.

``percentile`` keeps a value -> count map of a whole group in one task, and
sorting sends a hot value's rows to one task.  Selection needs neither: the
interval of values that holds a wanted rank is cut into equal bins, rows are
counted per bin (a map-side combine leaves at most one row per bin and task),
and the bin that holds the rank is the next interval.  Its ends are the least
and the greatest value met, each a bin of its own, so a value that is repeated
without end is settled as soon as it is an end.  An interval with few rows is
counted value by value.  All groups, columns and ranks advance in the same
jobs; the driver holds one interval per (group, column, rank) and the bins of
a round.  Interpolation is the linear rule of numpy's default and Spark's
``percentile``: position h = (n - 1) p between ranks floor(h) and ceil(h).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
FEW_ROWS = 10_000      # an interval of at most so many rows is counted by value
_MOST = 1.7e308        # infinite ends are cut here, for the width of bins only


@dataclass
class _Interval:
    group: tuple
    column: int
    low: float
    high: float
    before: int        # rows of the group below it
    rows: int
    ranks: list = field(default_factory=list)


def _values(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by..., _c (number of the column), _x: the values that are neither NULL nor NaN."""
    x = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    each = F.array(*[F.struct(F.lit(i).alias("_c"), x(c).alias("_x")) for i, c in enumerate(columns)])
    return (df.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.explode(each).alias("_v"))
            .select(*[f"_b{i}" for i in range(len(by))], "_v._c", "_v._x").where("_x IS NOT NULL"))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0 at the low end, bins + 1 at the high end, the equal parts between."""
    cut = lambda v: F.least(F.greatest(v, F.lit(-_MOST)), F.lit(_MOST)) / 2
    part = F.floor((cut(x) - cut(low)) / (cut(high) - cut(low)) * bins)
    return F.when(x <= low, 0.0).when(x >= high, float(bins + 1)).otherwise(
        F.least(F.greatest(part, F.lit(0)), F.lit(bins - 1)).cast("double") + 1)


def _settle(values: DataFrame, by: int, opens: list[_Interval], bins: int, few: int, fields: list) -> list[_Interval]:
    """One round: each open interval replaced by the bins that hold its ranks."""
    schema = T.StructType([*[T.StructField(f"_g{i}", fields[i].dataType) for i in range(by)],
                           T.StructField("_k", T.IntegerType()), T.StructField("_id", T.IntegerType()),
                           T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()),
                           T.StructField("_few", T.BooleanType())])
    table = values.sparkSession.createDataFrame(
        [(*o.group, o.column, i, o.low, o.high, o.rows <= few) for i, o in enumerate(opens)], schema)
    on = F.col("_c") == F.col("_k")
    for i in range(by):
        on = on & F.col(f"_b{i}").eqNullSafe(F.col(f"_g{i}"))
    inside = values.join(F.broadcast(table), on & F.col("_x").between(F.col("_lo"), F.col("_hi")))
    cell = F.when(F.col("_few"), F.col("_x")).otherwise(_bin(F.col("_x"), F.col("_lo"), F.col("_hi"), bins))
    found: dict[int, list] = {}
    for r in inside.groupBy("_id", cell.alias("_cell")).agg(
            F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(r["_id"], []).append((r["lo"], r["hi"], r["n"]))
    out = []
    for i, o in enumerate(opens):
        below = o.before
        for low, high, n in sorted(found[i]):
            ranks = [r for r in o.ranks if below <= r < below + n]
            if ranks:
                out.append(_Interval(o.group, o.column, low, high, below, n, ranks))
            below += n
    return out


def percentile_table(df: DataFrame, columns: dict[str, list[float]], by: list[str] = (), bins: int = BINS,
                     few_rows: int = FEW_ROWS) -> DataFrame:
    """by..., then for each column an array of its exact percentiles.

    One row per group (one in all without ``by``).  NULL and NaN are skipped;
    a group without values has an array of NULLs.  The groups (runs, tasks,
    strata, bins) come to the driver and should be few; rows never do.
    """
    by, names = list(by), list(columns)
    fields = [df.schema[b] for b in by]
    values = _values(df, names, by)
    groups = [f"_b{i}" for i in range(len(by))]
    stats = values.groupBy(*groups, "_c").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"),
                                              F.max("_x").alias("hi")).collect()
    opens, known, sizes = [], {}, {}
    for r in stats:
        group, column, n = tuple(r[g] for g in groups), r["_c"], r["n"]
        sizes[group, column] = n
        ranks = {f((n - 1) * p) for p in columns[names[column]] for f in (math.floor, math.ceil)}
        opens.append(_Interval(group, column, r["lo"], r["hi"], 0, n, sorted(ranks)))
    while opens:
        for o in [o for o in opens if o.low == o.high]:
            known.update({(o.group, o.column, r): o.low for r in o.ranks})
        opens = [o for o in opens if o.low != o.high]
        if opens:
            opens = _settle(values, len(by), opens, bins, few_rows, fields)

    def at(group: tuple, column: int, p: float):
        n = sizes.get((group, column))
        if not n:
            return None
        h = (n - 1) * p
        a, b = known[group, column, math.floor(h)], known[group, column, math.ceil(h)]
        return a if a == b else (math.ceil(h) - h) * a + (h - math.floor(h)) * b

    seen = list(dict.fromkeys(g for g, _ in sizes))
    if by:  # groups without any value have their row too
        seen += [g for g in map(tuple, df.select(*by).distinct().collect()) if g not in set(seen)]
    rows = [(*g, *[[at(g, i, p) for p in columns[c]] for i, c in enumerate(names)]) for g in (seen if by else [()])]
    schema = T.StructType([*fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]])
    return df.sparkSession.createDataFrame(rows, schema)


def exact_percentiles(df: DataFrame, col: str, probs: list[float], rows_per_range: int = FEW_ROWS) -> list:
    """The percentiles of one column as numbers (None without values)."""
    return list(percentile_table(df, {col: list(probs)}, few_rows=rows_per_range).first()[col])


def exact_percentiles_many(df: DataFrame, specs: list, rows_per_range: int = FEW_ROWS) -> list:
    """Several columns in the same jobs: [(column, probs), ...] -> [[values], ...]."""
    row = percentile_table(df, {c: list(p) for c, p in specs}, few_rows=rows_per_range).first()
    return [list(row[c]) for c, _ in specs]
