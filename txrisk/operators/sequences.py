"""Sequence windows and Δt corruption.

Windows are keyed rows (window_id, pos): a window holds at most L rows, so
every per-window step (array build, permutation) is bounded by L whatever
the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import quantize, seeded_uniform
from txrisk.operators.quantiles import exact_percentiles, percentile_table


def window_rows(ds: DataFrame, seq_len: int = 1024, warmup: int = 64, stride: int | None = None,
                idx: str = "_i", keep_tail: bool = False) -> DataFrame:
    """W5 + W6: assign each row of one split to its windows of L rows.

    ``idx`` is the 0-based position in the split's time order.  A window starts
    every ``stride`` rows (default L); n windows = max(1, (N - L) // stride + 1),
    rows in none of them are dropped, and N < L gives one short window.  A row
    comes once per window that holds it, at most ceil(L / stride) times.
    ``keep_tail`` keeps the last rows too, in short windows.  ``mask`` is false
    for the first ``warmup`` positions.
    """
    stride = stride or seq_len
    n = ds.count()
    n_win = max(1, -(-n // stride) if keep_tail else (n - seq_len) // stride + 1)
    i, last = F.col(idx).cast("bigint"), F.floor(F.col(idx) / stride).cast("bigint")
    if stride == seq_len:
        d = ds.withColumn("window_id", last).where(F.col("window_id") < F.lit(n_win))
    else:
        first = F.greatest(F.lit(0).cast("bigint"), F.floor((i - seq_len) / stride).cast("bigint") + 1)
        last = F.least(F.lit(n_win - 1).cast("bigint"), last)
        d = ds.where(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    d = d.withColumn("pos", (i - F.col("window_id") * stride).cast("int"))
    return d.withColumn("mask", F.col("pos") >= F.lit(warmup))


def window_summary(rows: DataFrame, flag_label: str = "is_mev_victim") -> DataFrame:
    """A16 + per-window shape: rows, unmasked rows, any positive, first/last tx."""
    return rows.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("mask").alias("n_mask"),
        F.coalesce(F.max(F.col(flag_label) > 0), F.lit(False)).alias("has_positive"),
        F.min_by("tx_id", "pos").alias("first_tx"), F.max_by("tx_id", "pos").alias("last_tx"))


def window_arrays(rows: DataFrame, cols: list[str] = (*S.FEATURE_COLUMNS, *S.LABEL_COLUMNS)) -> DataFrame:
    """D10 export: one row per window with an L-long array of structs in pos order."""
    return rows.groupBy("window_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", *cols, "mask"))).alias("rows"))


def shuffle_within_window(rows: DataFrame, col: str = "timestamp_delta_s", seed: int = 42,
                          out: str | None = None) -> DataFrame:
    """Permute ``col`` inside each window; the permutation comes from
    u(seed, window_id, pos), so it differs per window and is reproducible.

    The row at position p takes the value of the row whose hash rank is p.
    """
    out = out or f"{col}_shuffled"
    w = Window.partitionBy("window_id").orderBy("_u", "pos")
    src = rows.select("window_id", "pos", F.col(col).alias("_v"),
                      seeded_uniform(seed, F.col("window_id"), F.col("pos")).alias("_u"))
    src = src.withColumn("_r", (F.row_number().over(w) - 1).cast("int")).select(
        "window_id", F.col("_r").alias("pos"), F.col("_v").alias(out))
    return rows.join(src, ["window_id", "pos"])


def delta_bins(train: DataFrame, col: str = "timestamp_delta_s") -> dict:
    """A7 + P17 + A12: 3 edges (25/50/75th percentile of positive Δt, all Δt
    if none is positive) and 4 bin medians (left-closed bins; an empty bin
    takes the overall median), rounded to float32 like the reference.
    Returns {"edges", "medians", "median_pos"}: eight numbers.
    All selections are by counts: no task holds or sorts the values.
    """
    import numpy as np
    from txrisk.functions.scalar import digitize
    x = F.col(col).cast("double")
    v = train.select(x.alias("x"))
    if v.where(F.col("x") > 0).limit(1).count():
        v = v.where(F.col("x") > 0)
    e25, e50, e75 = exact_percentiles(v, "x", [0.25, 0.5, 0.75])
    edges = [float(np.float32(e)) for e in (e25, e50, e75)]
    per_bin = percentile_table(v.withColumn("bin", digitize("x", edges)), {"x": [0.5]}, ["bin"])
    meds = {r["bin"]: r["x"][0] for r in per_bin.collect()}  # <= 4 rows
    medians = [float(np.float32(meds.get(i, e50))) for i in range(4)]
    return {"edges": edges, "medians": medians, "median_pos": float(e50)}


def quantize_delta(df: DataFrame, edges: list[float], medians: list[float],
                   col: str = "timestamp_delta_s", out: str | None = None,
                   closed: str = "right") -> DataFrame:
    """F14 + J4: snap Δt to its bin median (bins applied right-closed, Q9)."""
    return df.withColumn(out or f"{col}_quantized", quantize(col, edges, medians, closed))


def gather_windows(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of every drawn window, repeated once per draw.  Both sides
    are keyed by window_id; a window holds at most L rows."""
    return draws.join(rows, "window_id")
