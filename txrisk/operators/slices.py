"""Slice metrics.

Slices are grouping keys: quantile strata, DEX / non-DEX, days and runs all
go through the same grouped metric operators in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators import metrics as M
from txrisk.operators.quantiles import percentile_table


def quantile_edges(df: DataFrame, col: str, probs: list[float], by: list[str] = ()) -> DataFrame:
    """A4/A5: by..., _edges: exact linear-interpolated percentiles (numpy's default)
    per group, selected by counts (no sort, no value map)."""
    return percentile_table(df, {col: list(probs)}, by).withColumnRenamed(col, "_edges")


def with_strata(df: DataFrame, col: str, probs: list[float], out: str, by: list[str] = (),
                offset: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """F15 + M10: stratum = number of edges <= x (np.digitize, left-closed) + offset.

    ``edges`` are those of ``quantile_edges``, one row per group (of ``df`` if not
    given), and broadcast: the groups are runs, not rows.
    """
    e = quantile_edges(df, col, probs, by) if edges is None else edges
    x = F.col(col).cast("double")
    idx = F.aggregate(F.col("_edges"), F.lit(0), lambda acc, v: acc + (x >= v).cast("int"))
    if by:
        d = df.join(F.broadcast(e), list(by))
    else:  # a handful of numbers: literals
        d = df.withColumn("_edges", F.array(*[F.lit(v).cast("double") for v in e.first()["_edges"]]))
    return d.withColumn(out, idx + F.lit(offset)).drop("_edges")


def traffic_quartile_metric(scored: DataFrame, by: list[str] = ("run_id",),
                            pressure: str = "mempool_pressure") -> DataFrame:
    """M10 + M9: quartiles 1..4 of pressure over the evaluated rows, MEV AP per
    quartile (single class -> 0.0, < 10 rows -> NULL), plus the boundaries."""
    by = list(by)
    edges = quantile_edges(scored, pressure, [0.25, 0.5, 0.75], by)
    d = with_strata(scored, pressure, [], "quartile", by, offset=1, edges=edges)
    keys = [*by, "quartile"]
    m = M.curve_metrics(M.score_curve(d, "score", "label", keys, above=0.5), keys)
    # every quartile of every run, also those without rows
    spine = edges.withColumn("quartile", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    out = spine.join(F.broadcast(m), keys, "left")
    rows = F.coalesce("n_valid", F.lit(0))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < rows)
    return out.select(*keys, rows.alias("n_rows"), F.when(rows < 10, F.lit(None).cast("double"))
                      .when(both, F.col("ap")).otherwise(F.lit(0.0)).alias("mev_pr_auc"),
                      *[F.col("_edges")[i].alias(f"p{c}") for i, c in enumerate((25, 50, 75))])


def dex_slices(df: DataFrame, flag: str = "is_dex_candidate") -> DataFrame:
    """Each row in 'overall' and in 'dex_only' or 'non_dex' (one pass)."""
    return df.withColumn("slice", F.explode(F.array(
        F.lit("overall"), F.when(F.col(flag), F.lit("dex_only")).otherwise(F.lit("non_dex")))))


def mev_pack(scored: DataFrame, by: list[str], key: str = "tx_id") -> DataFrame:
    """M11 metric pack per group: AP (positives and both classes), P@100,
    P@1000, R@1000 with k clamped to the group size; plus n and positives."""
    curve = M.score_curve(scored, "score", "label", by, above=0.5)
    hits = M.top_k_hits(scored, [100, 1000], "score", "label", by, key)
    # one row per group on either side
    m = M.curve_metrics(curve, by).withColumnRenamed("n_valid", "n").join(F.broadcast(hits), by, "left")
    both = (F.col("n_pos") >= 1) & (F.col("n_pos") < F.col("n"))
    return m.select(
        *by, "n", "n_pos",
        F.when(both, F.col("ap")).alias("mev_pr_auc"),
        M.precision_at_k(F.col("hits_100"), 100, F.col("n")).alias("mev_p_at_100"),
        M.precision_at_k(F.col("hits_1000"), 1000, F.col("n")).alias("mev_p_at_1000"),
        M.recall_at_k(F.col("hits_1000"), F.col("n_pos")).alias("mev_recall_at_1000"))


def dex_subset_table(scored: DataFrame, by: list[str] = ("run_id",)) -> DataFrame:
    """M11 + M12 + A13 + A15: pack per (run, slice), DEX counts, AP lift of the
    DEX slice over overall, and the DEX positive rate lift over the base rate."""
    by = list(by)
    pack = mev_pack(dex_slices(scored), [*by, "slice"])
    whole = Window.partitionBy(*by)  # the three slices of a run
    overall = lambda x: F.max(F.when(F.col("slice") == "overall", x)).over(whole)
    return pack.withColumns({
        "pr_auc_lift": F.when(F.col("slice") == "dex_only",
                              F.try_divide(F.col("mev_pr_auc"), overall(F.col("mev_pr_auc")))),
        "rate_lift": F.try_divide(F.col("n_pos") / F.col("n"), overall(F.col("n_pos") / F.col("n"))),
    })


def day_of(idx: str, n: str, days: int = 7) -> F.Column:
    """Equal-count day cut int(linspace(0, N, days+1)): day = ceil(days(i+1)/N) - 1."""
    return (F.expr(f"({days} * ({idx} + 1) + {n} - 1) div {n}") - 1).cast("int")


def pressure_quintiles(long: DataFrame, pressure_rows: DataFrame, by: list[str] = ("run_id",),
                       pressure: str = "mempool_pressure") -> DataFrame:
    """Quintile edges of pressure over the split's rows, then per (run, q):
    revert AUC (valid >= 10 and both classes, else 0.5) and MEV AP (>= 1
    positive and both classes, else 0.0).  Each run has all five rows.

    ``long`` has the rows of the tasks "revert" and "mev" (column ``task``); both
    are read off one curve."""
    by = list(by)
    edges = quantile_edges(pressure_rows, pressure, [0.2, 0.4, 0.6, 0.8])
    d = with_strata(long.where(F.col("task").isin("revert", "mev")), pressure, [], "q", edges=edges)
    d = d.where((F.col("task") == "mev") | (F.col("label") >= 0))
    keys = [*by, "q", "task"]
    m = M.curve_metrics(M.score_curve(d, "score", "label", keys, above=0.5), keys)
    rev, mev = F.col("task") == "revert", F.col("task") == "mev"
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_valid"))
    per = m.groupBy(*by).agg(F.collect_list(F.struct(  # ten rows of a run
        "q", F.when(rev & both & (F.col("n_valid") >= 10), F.col("auc")).alias("auc"),
        F.when(mev & both, F.col("ap")).alias("ap"))).alias("_m"))
    each = per.withColumn("q", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    best = lambda f: F.array_max(F.transform(F.filter("_m", lambda x: x["q"] == F.col("q")), lambda x: x[f]))
    return each.select(*by, "q", F.coalesce(best("auc"), F.lit(0.5)).alias("revert_auc"),
                       F.coalesce(best("ap"), F.lit(0.0)).alias("mev_pr_auc"))


def dex_per_day(scored: DataFrame, split_rows: DataFrame, by: list[str] = ("run_id",), days: int = 7,
                key: str = "tx_id") -> DataFrame:
    """Equal-count days over the split (W8), DEX rows only (P11); per
    (run, day): n_dex, positives, P@100, P@50 (k clamped), AP (NULL if one class).
    ``split_rows`` has the ``row_idx`` of all rows of the split: the days are
    cut over those, however many of them a run has scored."""
    # the split is contiguous in time, so its own index is row_idx - min(row_idx)
    s = split_rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("i0")).first()
    d = scored.withColumn("_n", F.lit(s["n"])).withColumn("_i", F.col("row_idx") - F.lit(s["i0"] or 0)) \
              .withColumn("day", day_of("_i", "_n", days))
    d = d.where(F.col("is_dex_candidate"))
    keys = [*by, "day"]
    hits = M.top_k_hits(d, [50, 100], "score", "label", keys, key)
    curve = M.score_curve(d, "score", "label", keys, above=0.5)
    m = M.curve_metrics(curve, keys).withColumnRenamed("n_valid", "n_dex").join(F.broadcast(hits), keys, "left")
    both = (F.col("n_pos") >= 1) & (F.col("n_pos") < F.col("n_dex"))
    return m.select(*keys, "n_dex", "n_pos",
                    M.precision_at_k(F.col("hits_100"), 100, F.col("n_dex")).alias("p_at_100"),
                    M.precision_at_k(F.col("hits_50"), 50, F.col("n_dex")).alias("p_at_50"),
                    F.when(both, F.col("ap")).alias("pr_auc"))
