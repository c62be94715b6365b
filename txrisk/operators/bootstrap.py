"""Bootstrap confidence intervals (M15, M16) with Poisson(1) resampling.

Each replicate is a grouping key: one job computes every replicate's metric
with weighted counts, then a percentile over the replicate values.  Weights
come from a seeded hash, so the same resamples are reproducible anywhere.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalar import poisson_n, seeded_uniform
from txrisk.operators import metrics as M
from txrisk.operators.sampling import bootstrap_weights
from txrisk.session import checkpoint_dir

WEIGHTED = ("f1", "auc", "ap", "p_at_k")


def weighted_metric(df: DataFrame, metric: str, by: list[str], k: int = 100,
                    key: str = "tx_id", max_group_rows: int | None = None) -> DataFrame:
    """One value per group for a weighted metric (weight column ``w``)."""
    w = F.col("w")
    if metric == "f1":
        c = M.confusion(df, (F.col("score") > 0.5).cast("int"), "label", by, weight=w)
        return c.select(*by, M.f1_from_counts().alias("value"))
    if metric in ("auc", "ap"):
        curve = M.score_curve(df, "score", "label", by, weight=w, max_group_rows=max_group_rows)
        if metric == "auc":
            return M.roc_auc(curve, by).withColumnRenamed("auc", "value")
        return M.average_precision(curve, by).withColumnRenamed("ap", "value")
    if metric == "p_at_k":
        # the weighted top k lies within the top k distinct rows (weights >= 1)
        win = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(key).asc())
        top = df.withColumn("_rn", F.row_number().over(win)).where(F.col("_rn") <= k)
        run = Window.partitionBy(*by).orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
        top = top.withColumn("_before", F.coalesce(F.sum(w).over(run), F.lit(0)))
        take = F.greatest(F.least(w, F.lit(k) - F.col("_before")), F.lit(0))
        n = df.groupBy(*by).agg(F.sum(w).alias("_n"))
        hits = top.groupBy(*by).agg(F.sum(take * F.col("label")).alias("_h"))
        if by:
            j = hits.join(n, by)
        else:  # one number: a literal
            j = hits.withColumn("_n", F.lit(n.first()[0]))
        return j.select(*by, (F.col("_h") / F.least(F.lit(k), F.col("_n"))).cast("double").alias("value"))
    raise ValueError(f"unknown metric {metric!r}; have {WEIGHTED}")


def _one_row(point: DataFrame, q: DataFrame) -> DataFrame:
    """Ungrouped case: the point and the interval are one row each; combine the
    three numbers on the driver instead of joining on a constant."""
    p, qq = point.first(), q.first()
    spark = point.sparkSession
    return spark.createDataFrame([(p["point"] if p else None, qq["_q"] if qq else None)],
                                 "point double, _q array<double>")


def bootstrap_ci(df: DataFrame, metric: str, reps: int = 1000, ci: float = 0.95, seed: int = 42,
                 by: list[str] = (), k: int = 100, key: str = "tx_id", boot: DataFrame | None = None,
                 biggest: int | None = None) -> DataFrame:
    """(by…, point, lower, upper).  Replicates with an undefined metric
    (e.g. one class) are skipped; if all are, the interval is the point.
    ``boot`` may pass precomputed replicate weights (T7) shared by several metrics."""
    by = list(by)
    if biggest is None:  # a replicate has at most as many distinct rows as its group
        biggest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
    point = weighted_metric(df.withColumn("w", F.lit(1)), metric, by, k, key, biggest) \
        .withColumnRenamed("value", "point")
    boot = bootstrap_weights(df, reps, seed, key) if boot is None else boot
    vals = weighted_metric(boot, metric, [*by, "rep"], k, key, biggest)
    a = (1 - ci) / 2
    q = vals.where(F.col("value").isNotNull()).groupBy(*by).agg(
        F.percentile("value", [a, 1 - a]).alias("_q"))
    out = point.join(q, by, "left") if by else _one_row(point, q)
    return out.select(*by, "point",
                      F.coalesce(F.col("_q")[0], F.col("point")).alias("lower"),
                      F.coalesce(F.col("_q")[1], F.col("point")).alias("upper"))


# ---------------------------------------------------------------------------
# grouped Poisson bootstrap: same resampling distribution, cost independent of N
# ---------------------------------------------------------------------------

def _group_weights(g: DataFrame, reps: int, seed: int, parts: list[str]) -> DataFrame:
    """Explode groups (with row count ``n``) into replicates; weight ~ Poisson(n),
    the exact law of the sum of the group's per-row Poisson(1) weights."""
    d = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = seeded_uniform(seed, "g", F.col("rep"), *[F.col(c) for c in parts])
    d = d.withColumn("w", poisson_n(F.col("n"), u))
    return d.where(F.col("w") > 0)


@dataclass(frozen=True)
class _Shared:
    """What the grouped metrics of one table read: written once, so that seven metrics
    don't read and join its rows anew."""
    counts: DataFrame  # by..., score, label, n
    sizes: DataFrame   # by..., _N
    top: DataFrame     # the first ``most`` rows of each group, with _rn
    most: int


def _share(df: DataFrame, by: list[str], ks: list[int], key: str) -> _Shared:
    spark = df.sparkSession
    root = os.path.join(checkpoint_dir(spark), "bootstrap", uuid.uuid4().hex)

    def stored(d: DataFrame, name: str) -> DataFrame:
        path = os.path.join(root, name)
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    slim = df.select(*by, key, "score", "label")
    counts = stored(slim.groupBy(*by, "score", "label").agg(F.count(F.lit(1)).alias("n")), "counts")
    most = max(map(_top_rows, ks))
    return _Shared(counts, counts.groupBy(*by).agg(F.sum("n").alias("_N")),
                   stored(_first_rows(slim, by, most, key), "top"), most)


def _top_rows(k: int) -> int:
    return k + 10 * math.ceil(math.sqrt(k)) + 10


def _first_rows(df: DataFrame, by: list[str], m: int, key: str) -> DataFrame:
    win = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(key).asc())
    return df.withColumn("_rn", F.row_number().over(win)).where(F.col("_rn") <= m)


def grouped_metric_values(df: DataFrame, metric: str, reps: int, seed: int, by: list[str],
                          k: int = 100, key: str = "tx_id", score_digits: int | None = None,
                          shared: _Shared | None = None):
    """(point, per-replicate values) with group-level weights.

    f1: the 4 confusion cells per group; auc / ap: distinct (score, label)
    (``score_digits`` rounds the replicates' scores, bounding the groups; the
    point estimate always uses exact scores); p_at_k: per-row
    weights for the top rows only plus one Poisson(N - M) for the rest, with
    M grown until every replicate's top rows hold >= k weight.
    """
    by = list(by)
    if metric in ("f1", "auc", "ap"):
        exact = df.groupBy(*by, "score", "label").agg(F.count(F.lit(1)).alias("n")) if shared is None else shared.counts
    if metric == "f1":
        cells = exact.groupBy(*by, (F.col("score") > 0.5).cast("int").alias("pred"), "label") \
                     .agg(F.sum("n").alias("n"))
        cells = cells.withColumn("score", F.when(F.col("pred") == 1, F.lit(1.0)).otherwise(F.lit(0.0)))
        point = weighted_metric(cells.withColumn("w", F.col("n")), "f1", by, k, key)
        boot = _group_weights(cells, reps, seed, [*by, "pred", "label"])
        return point, weighted_metric(boot, "f1", [*by, "rep"], k, key)
    if metric in ("auc", "ap"):
        g = exact if score_digits is None else \
            exact.groupBy(*by, F.round("score", score_digits).alias("score"), "label").agg(F.sum("n").alias("n"))
        # a replicate has at most as many different scores as its group has groups of rows
        biggest = exact.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
        point = weighted_metric(exact.withColumn("w", F.col("n")), metric, by, k, key, biggest)
        boot = _group_weights(g, reps, seed, [*by, "score", "label"])
        return point, weighted_metric(boot, metric, [*by, "rep"], k, key, biggest)
    if metric == "p_at_k":
        return _grouped_p_at_k(df, reps, seed, by, k, key, shared)
    raise ValueError(f"unknown metric {metric!r}")


def _grouped_p_at_k(df, reps, seed, by, k, key, shared=None):
    if shared is None:
        n_by = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_N"))
        point = weighted_metric(df.withColumn("w", F.lit(1)), "p_at_k", by, k, key)
    else:
        n_by = shared.sizes
        hits = shared.top.where(F.col("_rn") <= k).groupBy(*by).agg(F.sum("label").alias("_h"))
        point = hits.join(F.broadcast(n_by), by).select(  # one row per group
            *by, (F.col("_h") / F.least(F.lit(k), F.col("_N"))).cast("double").alias("value"))
    m = _top_rows(k)
    while True:
        top = _first_rows(df, by, m, key) if shared is None or m > shared.most else shared.top.where(F.col("_rn") <= m)
        tw = bootstrap_weights(top, reps, seed, key)  # same per-row draws as the row method
        run = Window.partitionBy(*by, "rep").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
        tw = tw.withColumn("_before", F.coalesce(F.sum("w").over(run), F.lit(0)))
        take = F.greatest(F.least(F.col("w"), F.lit(k) - F.col("_before")), F.lit(0))
        per = tw.groupBy(*by, "rep").agg(F.sum(take * F.col("label")).alias("_h"),
                                          F.sum("w").alias("_wtop"), F.count(F.lit(1)).alias("_c"))
        reps_df = n_by.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        per = reps_df.join(per, [*by, "rep"], "left").fillna(0, ["_h", "_wtop"])
        short = per.where((F.col("_wtop") < k) & (F.col("_N") > m)).limit(1).count()
        if short == 0:
            break
        m *= 4  # rare: some replicate's top rows weigh < k
    rest = poisson_n(F.greatest(F.col("_N") - F.lit(m), F.lit(0)),
                     seeded_uniform(seed, "rest", F.col("rep"), *[F.col(c) for c in by]))
    vals = per.withColumn("_tot", F.col("_wtop") + rest).select(
        *by, "rep", F.when(F.col("_tot") > 0, F.col("_h") / F.least(F.lit(k), F.col("_tot")))
        .cast("double").alias("value"))
    return point, vals


def grouped_bootstrap_ci(df: DataFrame, metric: str, reps: int = 1000, ci: float = 0.95,
                         seed: int = 42, by: list[str] = (), k: int = 100, key: str = "tx_id",
                         score_digits: int | None = None, shared: _Shared | None = None) -> DataFrame:
    """M15 at any N: (by…, point, lower, upper) from group-level Poisson weights."""
    by = list(by)
    point, vals = grouped_metric_values(df, metric, reps, seed, by, k, key, score_digits, shared)
    point = point.withColumnRenamed("value", "point")
    a = (1 - ci) / 2
    q = vals.where(F.col("value").isNotNull()).groupBy(*by).agg(F.percentile("value", [a, 1 - a]).alias("_q"))
    out = point.join(q, by, "left") if by else _one_row(point, q)
    return out.select(*by, "point", F.coalesce(F.col("_q")[0], F.col("point")).alias("lower"),
                      F.coalesce(F.col("_q")[1], F.col("point")).alias("upper"))


CI_BUNDLE = {"revert": ["f1", "auc"], "mev": ["ap", "p_at_100", "p_at_1000"], "drop": ["f1", "auc"]}
_NAMES = {"f1": "f1", "auc": "auc", "ap": "pr_auc", "p_at_100": "p_at_100", "p_at_1000": "p_at_1000"}


def _bundle_names(task: str) -> list[str]:
    return [f"{task}_{_NAMES[m]}" for m in CI_BUNDLE.get(task, [])]


KS = (100, 1000)
CHUNK = 4096  # rows whose vectors are held at once


class _Curve:
    """Sums of one (group, range) over scores from high to low, a vector of all
    replicates at a time; replicate 0 counts each row once and gives the point."""

    def __init__(self, width: int, before=None):
        import numpy as np
        zero = lambda: np.zeros(width, np.int64)
        self.cn, self.ctp = (zero(), zero()) if before is None else (before[0].copy(), before[1].copy())
        self.n, self.pos, self.tp, self.above, self.scored = zero(), zero(), zero(), zero(), zero()
        self.auc, self.ap = np.zeros(width), np.zeros(width)

    def add(self, score, n, pos) -> None:
        """Whole tie groups, scores falling; a NaN stands for NULL, which comes last."""
        import numpy as np
        ctp, cn = self.ctp + np.cumsum(pos, axis=0), self.cn + np.cumsum(n, axis=0)
        self.auc += ((n - pos) * (ctp - pos / 2)).sum(axis=0)
        self.ap += (pos * (ctp / np.maximum(cn, 1))).sum(axis=0)
        self.ctp, self.cn = ctp[-1], cn[-1]
        self.n, self.pos = self.n + n.sum(axis=0), self.pos + pos.sum(axis=0)
        self.scored = self.scored + pos[~np.isnan(score)].sum(axis=0)
        high = score > 0.5
        self.tp, self.above = self.tp + pos[high].sum(axis=0), self.above + n[high].sum(axis=0)

    def sums(self) -> list:
        return [self.n, self.pos, self.tp, self.above, self.scored, self.auc, self.ap]


def _vectors(batch, seed_width: int):
    """n and pos of each row of a batch: stored vectors, or drawn from the row's hash."""
    import numpy as np
    from txrisk.functions.scalar import replicate_weights
    n = np.zeros((batch.num_rows, seed_width), np.int64)
    label = batch.column("label").to_numpy(zero_copy_only=False)
    h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
    packed = batch.column("n").to_pylist()
    some = np.array([p is not None for p in packed], bool)
    raw = np.flatnonzero(~some)
    if len(raw):
        n[raw, 0] = 1
        n[raw, 1:] = replicate_weights(h1[raw], h2[raw], seed_width - 1)
    pos = n * np.where(some, 0, label).astype(np.int64)[:, None]
    for i in np.flatnonzero(some):
        n[i] = np.frombuffer(packed[i], "<i4")
        pos[i] = np.frombuffer(batch.column("pos")[int(i)].as_py(), "<i4")
    return n, pos


def metric_bundle_ci(long: DataFrame, reps: int = 1000, seed: int = 42, by: list[str] = (),
                     min_valid: int = 10, key: str = "tx_id", method: str = "rows",
                     score_digits: int | None = None,
                     rows_per_range: int = M.DEFAULT_SCORE_ROWS_PER_RANGE) -> DataFrame:
    """CI bundle over the task-unpivoted score table (by…, task, metric,
    point, lower, upper).  Guards: revert/drop need >= min_valid valid rows,
    mev needs a positive.  ``method`` "rows" weights every row in every
    replicate; "grouped" draws the same law per group of equal rows.  The
    caller chooses: the size of the data never does.

    "rows" moves N rows, not N x B: a row travels with one hash and its label,
    and the B weights are drawn where it is counted.  Rows of one task with an
    equal score are replaced by their summed vector as soon as that is smaller, so a
    score that a third of the rows share leaves one row per task.  Groups are cut in
    score ranges; the sums before a range are carried as vectors.
    """
    by = list(by)
    keys = [*by, "task"]
    v = M.valid(long)
    if method != "grouped":
        return _vector_ci(v, reps, seed, keys, min_valid, key, rows_per_range)
    all_of = _share(v, keys, list(KS), key)
    stats = all_of.counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("label")).alias("_p"))
    ok = stats.where(((F.col("task") != "mev") & (F.col("_n") >= min_valid))
                     | ((F.col("task") == "mev") & (F.col("_p") >= 1))).select(*keys)
    enough = lambda d: d.join(F.broadcast(ok), keys, "left_semi")  # noqa: E731  one row per (group, task)
    parts = []
    for task, mets in CI_BUNDLE.items():
        one = lambda d: enough(d.where(F.col("task") == task))
        shared = _Shared(one(all_of.counts), one(all_of.sizes), one(all_of.top), all_of.most)
        for m in mets:
            base, kk = (m, 100) if not m.startswith("p_at_") else ("p_at_k", int(m.split("_")[-1]))
            r = grouped_bootstrap_ci(one(v), base, reps, 0.95, seed, keys, kk, key, score_digits, shared)
            parts.append(r.withColumn("metric", F.lit(f"{task}_{_NAMES[m]}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "metric", "point", "lower", "upper")


def _vector_ci(v: DataFrame, reps: int, seed: int, keys: list[str], min_valid: int, key: str,
               rows_per_range: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    from txrisk.functions.scalar import replicate_weights, row_hash
    from txrisk.operators.scan import Ranges, plan_ranges
    from txrisk.session import ship_package
    spark = v.sparkSession
    ship_package(spark)
    width, names = reps + 1, ["k%d" % i for i in range(len(keys))]
    h1, h2 = row_hash(seed, F.col(key))
    rows = v.select(*[F.col(c).alias(k) for c, k in zip(keys, names)], F.col("score").cast("double").alias("score"),
                    F.col("label").cast("int").alias("label"), h1.alias("h1"), h2.alias("h2"), F.col(key).alias("_id"))
    biggest = rows.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    ranges = plan_ranges(rows, "score", rows_per_range) if biggest > rows_per_range else Ranges("score", (-np.inf, np.inf))
    rows = ranges.assign(rows, out="rng", src="score")
    if ranges.n > 1:  # NULL scores come last, as they sort
        rows = rows.withColumn("rng", F.when(F.col("score").isNull(), F.lit(-1)).otherwise(F.col("rng")))
    group = T.StructType([T.StructField(k, v.schema[c].dataType) for c, k in zip(keys, names)])
    fields = T.StructType([*group, T.StructField("rng", T.IntegerType()), T.StructField("score", T.DoubleType()),
                           T.StructField("label", T.IntegerType()), T.StructField("h1", T.LongType()),
                           T.StructField("h2", T.LongType()), T.StructField("n", T.BinaryType()),
                           T.StructField("pos", T.BinaryType())])

    def combine(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            pdf = b.select([*names, "rng", "score"]).to_pandas()
            code = pdf.groupby([*names, "rng", "score"], dropna=False, sort=False).ngroup().to_numpy()
            size = np.bincount(code)
            many = (size * 3 > width)[code]  # the vectors are smaller than the rows
            empty = pa.nulls(b.num_rows, pa.binary())
            plain = b.append_column("n", empty).append_column("pos", empty)
            yield plain.filter(pa.array(~many))
            at = np.flatnonzero(many)
            for part in np.array_split(at[np.argsort(code[at], kind="stable")], -(-len(at) // CHUNK) or 1):
                if len(part):
                    some = plain.take(pa.array(part))
                    n, pos = _vectors(some, width)
                    first = np.flatnonzero(np.concatenate([[True], code[part][1:] != code[part][:-1]]))
                    n, pos = (np.add.reduceat(x, first, axis=0).astype("<i4") for x in (n, pos))
                    one = some.take(pa.array(first)).select([*names, "rng", "score", "label", "h1", "h2"])
                    yield one.append_column("n", pa.array([x.tobytes() for x in n], pa.binary())).append_column(
                        "pos", pa.array([x.tobytes() for x in pos], pa.binary()))

    small = rows.select(*fields.names[:-2]).mapInArrow(combine, fields)

    def stretches(batches):
        """(group, range), then its rows in chunks."""
        for b in batches:
            for a in range(0, b.num_rows, CHUNK):
                part = b.slice(a, CHUNK)
                tags = list(zip(*(part.column(c).to_pylist() for c in [*names, "rng"])))
                cuts = [0, *[i for i in range(1, len(tags)) if tags[i] != tags[i - 1]], len(tags)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    if x < y:
                        yield tags[x], part.slice(x, y - x)

    def totals(batches):
        sums = {}
        for tag, part in stretches(batches):
            n, pos = _vectors(part, width)
            old = sums.setdefault(tag, [np.zeros(width, np.int64), np.zeros(width, np.int64)])
            old[0] += n.sum(axis=0)
            old[1] += pos.sum(axis=0)
        for tag, (n, pos) in sums.items():
            yield packed(tag, [n, pos])

    def packed(tag, vectors):
        cols = [pa.array([x], f.type) for x, f in zip(tag, arrow_tag)]
        return pa.RecordBatch.from_arrays(cols + [pa.array([np.stack(vectors).astype("<f8").tobytes()], pa.binary())],
                                          [*names, "rng", "sums"])

    from pyspark.sql.pandas.types import to_arrow_schema
    tag_type = T.StructType([*group, T.StructField("rng", T.IntegerType())])
    arrow_tag = list(to_arrow_schema(tag_type))
    sums_type = T.StructType([*tag_type, T.StructField("sums", T.BinaryType())])
    unpack = lambda raw: np.frombuffer(raw, "<f8").reshape(-1, width)
    before = {}
    if ranges.n > 1:  # what lies above each range: one vector per (group, range)
        per = {}
        for r in small.mapInArrow(totals, sums_type).toLocalIterator():
            tag = tuple(r)[:-1]
            per[tag] = per.get(tag, 0) + unpack(r["sums"])
        running = {}
        for tag in sorted(per, key=lambda t: -t[-1]):
            before[tag] = running.get(tag[:-1], np.zeros((2, width))).astype(np.int64)
            running[tag[:-1]] = before[tag] + per[tag].astype(np.int64)
    carried = spark.sparkContext.broadcast(before)

    def measure(batches):
        now = curve = last = None

        def close():  # the last tie group of a range
            curve.add(np.array([last[0]]), last[1][None, :], last[2][None, :])
            return packed(now, curve.sums())

        for tag, part in stretches(batches):
            if tag != now:
                if now is not None:
                    yield close()
                now, curve, last = tag, _Curve(width, carried.value.get(tag)), None
            n, pos = _vectors(part, width)
            score = part.column("score").to_numpy(zero_copy_only=False).astype(float)
            same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            score, n, pos = score[first], np.add.reduceat(n, first, axis=0), np.add.reduceat(pos, first, axis=0)
            if last is not None and (score[0] == last[0] or (np.isnan(score[0]) and np.isnan(last[0]))):
                n[0] += last[1]
                pos[0] += last[2]
            elif last is not None:
                curve.add(np.array([last[0]]), last[1][None, :], last[2][None, :])
            if len(score) > 1:
                curve.add(score[:-1], n[:-1], pos[:-1])
            last = (score[-1], n[-1], pos[-1])
        if now is not None:
            yield close()

    curves = (small.repartition(*names, "rng").sortWithinPartitions(*names, "rng", F.col("score").desc_nulls_last())
              .mapInArrow(measure, sums_type))
    whole = {}
    for r in curves.toLocalIterator():  # one row per (group, range)
        tag = tuple(r)[:-2]
        whole[tag] = whole.get(tag, 0) + unpack(r["sums"])

    def hits(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_rn").to_numpy())
        w = np.ones((len(order), width), np.int64)
        w[:, 1:] = replicate_weights(*(table.column(c).to_numpy()[order] for c in ("h1", "h2")), reps)
        label = table.column("label").to_numpy()[order]
        above = np.cumsum(w, axis=0) - w
        out = [w.sum(axis=0)] + [(np.clip(k - above, 0, w) * label[:, None]).sum(axis=0) for k in KS]
        return pa.Table.from_batches([packed((*[table.column(k)[0].as_py() for k in names], 0), out)])

    tops, most = {}, max(KS) + 10 * math.ceil(math.sqrt(max(KS))) + 10
    mev = rows.where(F.col(names[-1]) == "mev")
    while True:  # until the top rows of every replicate weigh enough; once, but for odds of 1e-20
        win = Window.partitionBy(*names).orderBy(F.col("score").desc(), F.col("_id").asc())
        top = mev.withColumn("_rn", F.row_number().over(win)).where(F.col("_rn") <= most)
        for r in top.select(*names, "h1", "h2", "label", "_rn").groupBy(*names).applyInArrow(hits, sums_type).collect():
            tops[tuple(r)[:-2]] = unpack(r["sums"])
        if all((t[0] >= np.minimum(max(KS), whole[g][0])).all() for g, t in tops.items()):
            break
        most *= 4

    out = []
    for g, (n, pos, tp, above, scored, auc, ap) in whole.items():
        task = g[-1]
        if (n[0] < min_valid) if task != "mev" else (pos[0] < 1):
            continue
        neg, den = n - pos, 2 * tp + (above - tp) + (scored - tp)
        known = {"f1": np.where(den > 0, 2 * tp / np.maximum(den, 1), 0.0),
                 "auc": np.where((pos > 0) & (neg > 0), auc / np.maximum(pos * neg, 1), np.nan),
                 "ap": np.where(pos > 0, ap / np.maximum(pos, 1), np.nan)}
        for i, k in enumerate(KS):
            if g in tops:
                known[f"p_at_{k}"] = np.where(n > 0, tops[g][1 + i] / np.maximum(np.minimum(k, n), 1), np.nan)
        if reps:
            known["f1"][1:][n[1:] == 0] = np.nan  # a replicate without rows
        for m, name in zip(CI_BUNDLE.get(task, []), _bundle_names(task)):
            point, draws = known[m][0], known[m][1:][~np.isnan(known[m][1:])]
            low, high = np.percentile(draws, [2.5, 97.5]) if len(draws) else (point, point)
            out.append((*g, name, *(None if np.isnan(x) else float(x) for x in (point, low, high))))
    schema = T.StructType([*[v.schema[c] for c in keys], T.StructField("metric", T.StringType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("point", "lower", "upper")]])
    return spark.createDataFrame(out, schema)
