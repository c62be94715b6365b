"""Deterministic sampling operators (T3-T8) on seeded hash uniforms.

``rand()`` depends on partitioning; a uniform from md5(seed | ... | key) is the
same on any cluster, after any retry, and in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import replicate_weight_array, seeded_uniform
from txrisk.operators.scan import plan_ranges, with_row_index
from txrisk.sources.raw import smoke_slice


def first_n(df: DataFrame, n: int, order: list[str] = (S.SORT_KEY, "tx_id"),
            rows_per_range: int | None = None) -> DataFrame:
    """The first n rows in time order, exactly, for any n.

    Whole leading time ranges are taken as they are (counts per range come
    back, <= P rows); only the range that crosses n is ranked.  No task
    receives more than n + one range of rows (a plain top-k merge would pull
    n rows from every partition into one task).
    """
    from txrisk.operators.scan import DEFAULT_ROWS_PER_RANGE
    order = list(order)
    ranges = plan_ranges(df, order[0], rows_per_range or DEFAULT_ROWS_PER_RANGE,
                         tiebreak=order[1] if len(order) > 1 else None)
    if ranges.n == 1:
        return smoke_slice(df, n, order[0], order[1])
    d = ranges.assign(df, "_rng", order[0])
    counts = sorted(d.groupBy("_rng").count().collect())
    acc, last = 0, None
    for r, c in counts:
        last = r
        acc += c
        if acc >= n:
            break
    head = d.where(F.col("_rng") <= F.lit(last)).drop("_rng")
    return row_index(head, order, "_i").where(F.col("_i") < n).drop("_i")


def row_index(df: DataFrame, order: list[str] = (S.SORT_KEY, "tx_id"), out: str = "row_idx") -> DataFrame:
    """W9 for any table (ranged scan on the first order column)."""
    order = list(order)
    tie = order[1] if len(order) > 1 else None
    return with_row_index(df, plan_ranges(df, order[0], tiebreak=tie), order, out)


def shuffle_labels(df: DataFrame, label: str, seed: int = 42, key: str = "tx_id",
                   order: list[str] = (S.SORT_KEY, "tx_id")) -> DataFrame:
    """T4: permute ``label`` against the other columns.

    Row i in time order receives the label of the row ranked i-th by a seeded
    hash; both ranks are distributed scans, joined on the rank.
    """
    by_time = row_index(df.drop(label), order, "_i")
    lab = df.select(key, label).withColumn("_u", seeded_uniform(seed, "shuffle", F.col(key)))
    by_hash = row_index(lab, ["_u", key], "_i").select("_i", F.col(label).alias("_lab"))
    return by_time.join(by_hash, "_i").withColumn(label, F.col("_lab")).drop("_lab", "_i")


def half_split(df: DataFrame, order: list[str] = (S.SORT_KEY, "tx_id")) -> tuple[DataFrame, DataFrame]:
    """T5: first half (by time) / second half, split at floor(n/2)."""
    d = row_index(df, order, "_i")
    half = d.count() // 2
    return d.where(F.col("_i") < half).drop("_i"), d.where(F.col("_i") >= half).drop("_i")


def bootstrap_weights(df: DataFrame, reps: int, seed: int = 42, key: str = "tx_id") -> DataFrame:
    """One Poisson(1) weight per (replicate, row): the with-replacement
    resample as counts.  Rows with weight 0 are dropped.

    A row is hashed once; its weights are that hash mixed with the number of the
    replicate, so they depend on nothing but (seed, key, replicate).
    """
    draws = F.transform(replicate_weight_array(seed, F.col(key), reps),
                        lambda w, r: F.struct(r.alias("rep"), w.alias("w")))
    d = df.withColumn("_d", F.explode(F.filter(draws, lambda x: x["w"] > 0)))
    return d.withColumns({"rep": F.col("_d.rep"), "w": F.col("_d.w")}).drop("_d")


def minibatches(df: DataFrame, batch_size: int, epoch: int = 0, seed: int = 42,
                key: str = "tx_id") -> DataFrame:
    """A shuffled order per epoch and a batch id floor(i / B)."""
    d = df.withColumn("_u", seeded_uniform(seed, epoch, F.col(key)))
    d = row_index(d, ["_u", key], "_i")
    return d.withColumn("batch_id", F.floor(F.col("_i") / F.lit(batch_size)).cast("bigint")) \
            .drop("_u", "_i")


def positive_aware_sample(windows: DataFrame, n_draws: int | None = None, p_pos: float = 0.3,
                          seed: int = 42, flag: str = "has_positive") -> DataFrame:
    """N draws with replacement; with probability p pick a window holding a
    positive, else any window.  Draw d uses uniforms u(seed,'pick',d) and
    u(seed,'idx',d) mapped to a dense rank (no driver-side index lists).
    Output: (draw, window_id) -> join to windows (J3) for the rows.
    """
    n_win = windows.count()
    n_draws = n_win if n_draws is None else n_draws
    spark = windows.sparkSession
    pos = row_index(windows.where(F.col(flag)).select("window_id"), ["window_id"], "_pi")
    n_pos = pos.count()
    draws = spark.range(n_draws).withColumnRenamed("id", "draw").withColumns({
        "_pick": seeded_uniform(seed, "pick", F.col("draw")),
        "_v": seeded_uniform(seed, "idx", F.col("draw")),
    })
    use_pos = (F.col("_pick") < F.lit(p_pos)) & F.lit(n_pos > 0)
    draws = draws.withColumns({
        "_from_pos": use_pos,
        "_j": F.when(use_pos, F.floor(F.col("_v") * F.lit(max(n_pos, 1))))
               .otherwise(F.floor(F.col("_v") * F.lit(max(n_win, 1)))).cast("bigint"),
    })
    all_idx = row_index(windows.select("window_id"), ["window_id"], "_ai")
    a = draws.where(~F.col("_from_pos")).join(all_idx, F.col("_j") == F.col("_ai"))
    b = draws.where(F.col("_from_pos")).join(pos, F.col("_j") == F.col("_pi"))
    return a.select("draw", "window_id", F.lit(False).alias("from_positive")).unionByName(
        b.select("draw", "window_id", F.lit(True).alias("from_positive")))
