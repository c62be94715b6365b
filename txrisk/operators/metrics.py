"""Exact distributed ranking metrics over score tables.

Input: rows with a score, a label in {-1, 0, 1} (-1 = unknown) and optional
slice columns ``by``.  Every metric is computed per ``by`` group in one job,
so slices, runs, tasks and bootstrap replicates are just more grouping keys.

Ties: AUC counts a tied positive/negative pair as 1/2 and AP groups tied
scores into one threshold (as sklearn does); top-k breaks ties by the key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.scan import Ranges, plan_ranges, running_totals

DEFAULT_SCORE_ROWS_PER_RANGE = 2_000_000


def valid(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop rows whose label is unknown (-1)."""
    return df.where(F.col(label) >= 0)


def score_curve(df: DataFrame, score: str = "score", label: str = "label", by: list[str] = (),
                weight: Column | None = None,
                rows_per_range: int = DEFAULT_SCORE_ROWS_PER_RANGE,
                max_group_rows: int | None = None, score_digits: int | None = None,
                above: float | None = None) -> DataFrame:
    """One row per (by, distinct score), high to low, with cumulative counts.

    Columns: by..., score, n, pos, ctp (positives at score >= this one),
    cn (rows at score >= this one), tot_pos, tot_neg (group totals).  ``weight`` counts a
    row several times (bootstrap).  The running sums go through
    ``running_totals`` on score ranges, so a slice with N distinct scores
    is split over ceil(N / rows_per_range) tasks.  Ranges are planned from
    all groups' scores together, so a range holds at most about
    ``rows_per_range`` of any group, and only when the largest group
    (``max_group_rows``, measured when not given) needs them: many small groups
    already spread over tasks through ``by``.  ``score_digits`` rounds scores
    first: at most 10^digits distinct scores per group, an approximate AUC/AP
    with a bounded curve.  ``above`` adds ``n_above`` and ``pos_above``: the rows
    and positives whose score, before rounding, is greater.
    """
    by = list(by)
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    y = F.col(label).cast("bigint")
    aggs = [F.sum(w).alias("n"), F.sum(w * y).alias("pos")]
    if above is not None:
        more = F.coalesce((F.col("_exact") > above).cast("bigint"), F.lit(0))
        aggs += [F.sum(w * more).alias("n_above"), F.sum(w * y * more).alias("pos_above")]
        df = df.withColumn("_exact", F.col(score))
    if score_digits is not None:  # approximate fast path: bounded distinct scores
        df = df.withColumn(score, F.round(score, score_digits))
    g = df.groupBy(*by, score).agg(*aggs)
    g = g.where(F.col("n") > 0)
    if max_group_rows is None:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
        max_group_rows = sizes.agg(F.max("_c")).first()[0] or 0
    if max_group_rows <= rows_per_range:
        ranges = Ranges(score, (-math.inf, math.inf))
    else:
        ranges = plan_ranges(g, score, rows_per_range)
    g = ranges.assign(g, out="_rng", src=score)
    if ranges.n > 1:  # NULL scores come last, as they sort
        g = g.withColumn("_rng", F.when(F.col(score).isNull(), F.lit(-1)).otherwise(F.col("_rng")))
    g = running_totals(g, by, "_rng", ranges.n, [F.col(score).desc()],
                       {"ctp": (F.col("pos"), True), "cn": (F.col("n"), True)}, descending=True,
                       totals={"tot_pos": "ctp", "_tot": "cn"})
    return g.withColumn("tot_neg", F.col("_tot") - F.col("tot_pos")).drop("_rng", "_tot")


def curve_metrics(curve: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    """One aggregate over a curve with ``above``: tp, fp, fn, tn, n_valid, n_pos,
    auc and ap per group, as ``confusion``, ``roc_auc`` and ``average_precision`` give them."""
    neg = F.col("n") - F.col("pos")
    p, q = F.first("tot_pos"), F.first("tot_neg")
    tp, hits = F.sum("pos_above"), F.sum("n_above")
    below = F.sum(F.when(F.col("_scored"), F.col("pos")).otherwise(0))
    rest = F.sum(F.when(F.col("_scored"), neg).otherwise(0))
    return curve.withColumn("_scored", F.col(score).isNotNull()).groupBy(*by).agg(
        tp.alias("tp"), (hits - tp).alias("fp"), (below - tp).alias("fn"), (rest - hits + tp).alias("tn"),
        (p + q).alias("n_valid"), p.alias("n_pos"),
        F.when((p > 0) & (q > 0), F.sum(neg * (F.col("ctp") - F.col("pos") / 2.0)) / (p.cast("double") * q))
        .alias("auc"),
        F.when(p > 0, F.sum(F.col("pos") * F.col("ctp") / F.col("cn").cast("double")) / p).alias("ap"))


def roc_auc(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """M3: P(score_pos > score_neg) + P(tie)/2; NULL unless both classes present."""
    neg = F.col("n") - F.col("pos")
    agg = curve.groupBy(*by).agg(
        F.sum(neg * (F.col("ctp") - F.col("pos") / 2.0)).alias("_s"),
        F.first("tot_pos").alias("_p"), F.first("tot_neg").alias("_q"))
    return agg.select(*by, F.when((F.col("_p") > 0) & (F.col("_q") > 0),
                                  F.col("_s") / (F.col("_p").cast("double") * F.col("_q")))
                      .alias("auc"))


def average_precision(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """M4: step-wise AP = sum_g pos_g/P * precision_g (ties form one step)."""
    agg = curve.groupBy(*by).agg(
        F.sum(F.col("pos") * F.col("ctp") / F.col("cn").cast("double")).alias("_s"),
        F.first("tot_pos").alias("_p"))
    return agg.select(*by, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("ap"))


def pr_curve(curve: DataFrame, score: str = "score", by: list[str] = ()) -> DataFrame:
    """M7: one point per distinct score plus the terminal point (p=1, r=0)."""
    pts = curve.select(*by, F.col(score).alias("threshold"),
                       (F.col("ctp") / F.col("cn").cast("double")).alias("precision"),
                       F.when(F.col("tot_pos") > 0, F.col("ctp") / F.col("tot_pos").cast("double"))
                        .otherwise(F.lit(1.0)).alias("recall"))
    end = curve.select(*by).distinct().select(*by, F.lit(None).cast(pts.schema["threshold"].dataType)
                                               .alias("threshold"),
                                               F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def confusion(df: DataFrame, pred: Column, label: str = "label", by: list[str] = (),
              weight: Column | None = None) -> DataFrame:
    """A19 (+A10 inputs): tp, fp, fn, tn, n, P per group."""
    y = F.col(label).cast("int")
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    s = lambda c: F.sum(F.when(c, w).otherwise(F.lit(0).cast("bigint")))
    return df.groupBy(*by).agg(
        s((pred == 1) & (y == 1)).alias("tp"), s((pred == 1) & (y == 0)).alias("fp"),
        s((pred == 0) & (y == 1)).alias("fn"), s((pred == 0) & (y == 0)).alias("tn"),
        F.sum(w).alias("n_valid"), F.sum(w * y).alias("n_pos"))


def f1_from_counts(tp="tp", fp="fp", fn="fn") -> Column:
    """M1: 2tp / (2tp + fp + fn), 0 when the denominator is 0."""
    den = 2 * F.col(tp) + F.col(fp) + F.col(fn)
    return F.when(den > 0, 2 * F.col(tp) / den.cast("double")).otherwise(F.lit(0.0))


def accuracy_from_counts(tp="tp", tn="tn", n="n_valid") -> Column:
    """M2."""
    return (F.col(tp) + F.col(tn)) / F.col(n).cast("double")


def top_k_hits(df: DataFrame, ks: list[int], score: str = "score", label: str = "label",
               by: list[str] = (), key: str = "tx_id") -> DataFrame:
    """T2 + M5/M6 inputs: positives among the top k rows per group (ties by key).

    ``row_number() <= max(k)`` lets Spark insert a partial WindowGroupLimit
    before the shuffle, so each map task forwards at most max(k) rows per group.
    """
    kmax = max(ks)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key).asc())
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= kmax)
    y = F.col(label).cast("bigint")
    return top.groupBy(*by).agg(*[
        F.sum(F.when(F.col("_rn") <= k, y).otherwise(F.lit(0).cast("bigint"))).alias(f"hits_{k}")
        for k in ks])


def precision_at_k(hits: Column, k: int, n: Column) -> Column:
    """M5: hits / min(k, n) (k clamped to the group size)."""
    return hits / F.least(F.lit(k), n).cast("double")


def recall_at_k(hits: Column, P: Column) -> Column:
    """M6: hits / P, 0 when there is no positive."""
    return F.when(P > 0, hits / P.cast("double")).otherwise(F.lit(0.0))


def metric_bundle(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label",
                  task: str = "task", key: str = "tx_id", min_valid: int = 10,
                  ks: tuple = (100, 1000), recall_k: int = 1000,
                  score_digits: int | None = None) -> DataFrame:
    """M8: the per-task metric set with the reference's guards, as a long table
    (by..., task, metric, value).

    revert / drop: F1 and accuracy (revert) at > 0.5, AUC when both classes are
    present; skipped below ``min_valid`` valid rows.  mev: AP when both classes
    are present, P@k, R@k; skipped without a positive.
    """
    keys = [*by, task]
    v = valid(scored, label)
    curve = score_curve(v, score, label, keys, score_digits=score_digits, above=0.5)  # digits: approximate
    hits = top_k_hits(v, list(ks), score, label, keys, key)
    m = curve_metrics(curve, keys, score).join(hits, keys, "left")
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_valid"))
    enough = F.col("n_valid") >= min_valid
    has_pos = F.col("n_pos") >= 1
    is_t = lambda t: F.col(task) == t
    entries = [
        ("revert_f1", is_t("revert") & enough, f1_from_counts()),
        ("revert_accuracy", is_t("revert") & enough, accuracy_from_counts()),
        ("revert_auc", is_t("revert") & enough & both, F.col("auc")),
        ("drop_f1", is_t("drop") & enough, f1_from_counts()),
        ("drop_auc", is_t("drop") & enough & both, F.col("auc")),
        ("mev_pr_auc", is_t("mev") & has_pos & both, F.col("ap")),
    ]
    for k in ks:
        entries.append((f"mev_p_at_{k}", is_t("mev") & has_pos,
                        precision_at_k(F.col(f"hits_{k}"), k, F.col("n_valid"))))
    entries.append((f"mev_recall_at_{recall_k}", is_t("mev") & has_pos,
                    recall_at_k(F.col(f"hits_{recall_k}"), F.col("n_pos"))))
    arr = F.array(*[F.when(cond, F.struct(F.lit(name).alias("metric"), val.cast("double").alias("value")))
                    for name, cond, val in entries])
    out = m.select(*keys, F.explode(arr).alias("_m")).where(F.col("_m").isNotNull())
    return out.select(*keys, F.col("_m.metric").alias("metric"), F.col("_m.value").alias("value"))


def unpivot_tasks(df: DataFrame, keep: list[str] = ("tx_id",),
                  tasks: dict | None = None) -> DataFrame:
    """(…, revert_score, mev_score, drop_score, labels…) -> (…, task, score, label)."""
    from txrisk.schema import TASKS
    tasks = tasks or TASKS
    arr = F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"{t}_score").cast("double").alias("score"),
                             F.col(lab).cast("double").alias("label")) for t, lab in tasks.items()])
    return df.select(*keep, F.explode(arr).alias("_t")).select(*keep, "_t.task", "_t.score", "_t.label")


@dataclass(frozen=True)
class Metric:
    """§2.12: a metric whose state merges.  ``partial(scores, n, pos)`` gives the state (a list
    of floats) of tie groups with falling scores (numpy arrays: a score's rows and
    positives), ``merge(high, low)`` joins the states of two neighbouring stretches and
    ``finish(state)`` gives the value (or None)."""
    partial: Callable
    merge: Callable
    finish: Callable


def _auc_partial(scores, n, pos) -> list:
    above = np.cumsum(pos) - pos / 2
    return [float(pos.sum()), float((n - pos).sum()), float(((n - pos) * above).sum())]


AUC = Metric(_auc_partial, lambda a, b: [a[0] + b[0], a[1] + b[1], a[2] + b[2] + a[0] * b[1]],
             lambda s: s[2] / (s[0] * s[1]) if s[0] and s[1] else None)


def mergeable_metric(df: DataFrame, by: list[str], metric: Metric, name: str = "value", score: str = "score",
                     label: str = "label", rows_per_range: int = DEFAULT_SCORE_ROWS_PER_RANGE) -> DataFrame:
    """§2.12 for groups of any size: by..., value of a ``Metric`` written in Python.

    Rows are counted per (group, score) first, so a score shared by many rows is one
    tie group; tie groups are cut in score ranges, each streamed in chunks with one
    state held, and a group's states (one per range) are merged from high to low.
    NULL scores come last, as NaN.
    """
    from pyspark.sql import types as T
    from txrisk.session import ship_package
    ship_package(df.sparkSession)
    by = list(by)
    g = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    ranges = plan_ranges(g, "_s", rows_per_range)
    g = ranges.assign(g, "_rng", "_s").withColumn("_rng", F.when(F.col("_s").isNull(), F.lit(-1)).otherwise(F.col("_rng")))
    tag = [df.schema[b] for b in by]
    states = T.StructType([*tag, T.StructField("_rng", T.IntegerType()), T.StructField("_state", T.ArrayType(T.DoubleType()))])

    def stretches(batches, columns):
        for b in batches:
            tags = list(zip(*(b.column(c).to_pylist() for c in columns))) if columns else [()] * b.num_rows
            cuts = [0, *[i for i in range(1, len(tags)) if tags[i] != tags[i - 1]], len(tags)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x < y:
                    yield tags[x], b.slice(x, y - x)

    def fold(batches, columns, state_of, out):
        now = state = None
        for t, part in stretches(batches, columns):
            s = state_of(part)
            if t == now:
                state = metric.merge(state, s)
            else:
                if now is not None:
                    yield out(now, state)
                now, state = t, s
        if now is not None:
            yield out(now, state)

    def row(fields, values):
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(fields)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], kinds.names)

    def measure(batches):
        col = lambda part, c: part.column(c).to_numpy(zero_copy_only=False).astype(float)
        yield from fold(batches, [*by, "_rng"], lambda p: list(metric.partial(col(p, "_s"), col(p, "_n"), col(p, "_p"))),
                        lambda t, s: row(states, [*t, s]))

    result = T.StructType([*tag, T.StructField(name, T.DoubleType())])

    def combine(batches):
        def all_of(part):
            each = part.column("_state").to_pylist()
            return reduce(metric.merge, each)
        yield from fold(batches, by, all_of, lambda t, s: row(result, [*t, metric.finish(s)]))

    per_range = (g.repartition(*by, "_rng").sortWithinPartitions(*by, "_rng", F.col("_s").desc_nulls_last())
                 .mapInArrow(measure, states))
    spread = per_range.repartition(*by) if by else per_range.coalesce(1)  # one small row per range
    return spread.sortWithinPartitions(*by, F.col("_rng").desc()).mapInArrow(combine, result)


def grouped_metric(df: DataFrame, by: list[str], fn, name: str = "value", score: str = "score",
                   label: str = "label", max_group_rows: int = 5_000_000) -> DataFrame:
    """§2.12 escape hatch: any Python ``fn(scores, labels) -> float`` per group
    through ``applyInPandas`` (the reference's metric_fn hook).

    ``fn`` sees a whole group, so a group is handed to one Python worker and the
    call refuses groups above ``max_group_rows``.  A metric that can be written with
    partial states goes through ``mergeable_metric`` at any size.
    """
    import pandas as pd
    from pyspark.sql import types as T
    from txrisk.session import ship_package
    ship_package(df.sparkSession)
    biggest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if biggest > max_group_rows:
        raise ValueError(f"largest group has {biggest} rows > {max_group_rows}; use mergeable_metric or the built-in metrics")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            v = float(fn(pdf[score].to_numpy(), pdf[label].to_numpy()))
        except (ValueError, ZeroDivisionError):
            v = None
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, name: [v]})

    schema = T.StructType([df.schema[b] for b in by] + [T.StructField(name, T.DoubleType())])
    return df.select(*by, score, label).groupBy(*by).applyInPandas(apply, schema)
