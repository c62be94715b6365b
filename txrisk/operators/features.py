"""Causal transaction features (W1-W4, W10, F1-F5, P8) as one logical plan.

Order everywhere is (timestamp_ms, tx_id): ties in time are broken by the key,
so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions import scalar as X
from txrisk.operators.scan import TIME_ROWS_PER_RANGE, Ranges, plan_ranges, running_totals
from txrisk.operators.trailing import time_order


def plan_time_ranges(tx: DataFrame, rows_per_range: int | None = None, **kw) -> Ranges:
    return plan_ranges(tx, S.SORT_KEY, rows_per_range or TIME_ROWS_PER_RANGE, tiebreak="tx_id", **kw)


def time_features(tx: DataFrame, ranges: Ranges, window_ms: int = S.PRESSURE_WINDOW_MS,
                  clip_max: float = S.DELTA_CLIP_MAX, first_delta: float = 0.0) -> DataFrame:
    """W1 inter-arrival seconds (clipped [0, 300]; ``first_delta`` for the row
    with no predecessor), W4 trailing 60 s arrival count, W9 row index.  Keyed by tx_id."""
    t = with_time_features(tx.select("tx_id", S.SORT_KEY), ranges, window_ms, clip_max, first_delta)
    return t.drop(S.SORT_KEY)


def with_time_features(tx: DataFrame, ranges: Ranges, window_ms: int = S.PRESSURE_WINDOW_MS,
                       clip_max: float = S.DELTA_CLIP_MAX, first_delta: float = 0.0) -> DataFrame:
    """The same columns added to ``tx``, whose own travel along."""
    t = time_order(tx, ranges, lookback_ms=window_ms)
    delta = (F.col(S.SORT_KEY) - F.col("prev_ts")).cast("double") / 1000.0
    return t.withColumns({
        "timestamp_delta_s": F.when(F.col("prev_ts").isNull(), F.lit(float(first_delta)))
                              .otherwise(X.clip(delta, 0.0, clip_max)),
        "mempool_pressure": F.col("pressure").cast("float"),
    }).drop("prev_ts", "pressure")


def _sender_key() -> F.Column:
    # NULL senders get one key per row so they never form a hot group
    return F.coalesce(F.col("from_addr"), F.concat(F.lit("\u0000"), F.col("tx_id").cast("string")))


def sender_features(tx: DataFrame, ranges: Ranges, snapshot: DataFrame | None = None) -> DataFrame:
    """W2 expanding tx count per sender (current row included) and W3 mean of
    the sender's past log1p(gas_price/1e9) (current row excluded, 0 if none).

    Runs per (sender, time range) so a sender owning a third of all rows is
    spread over P tasks; earlier ranges are carried by ``running_totals``.
    ``snapshot`` (from_addr, _pre_count, _pre_gas_sum) seeds state for an
    incremental build (J1).
    """
    s = tx.select("tx_id", S.SORT_KEY, "from_addr", past_gas().alias("_g"))
    return with_sender_features(s, ranges, snapshot).select("tx_id", "sender_tx_count", "sender_avg_gas")


def past_gas() -> F.Column:
    """log1p(gas price in gwei) of a raw row, what W3 averages."""
    return F.log1p(F.col("gas_price").cast("double") / 1e9)


def with_sender_features(df: DataFrame, ranges: Ranges, snapshot: DataFrame | None = None) -> DataFrame:
    """W2 and W3 added to ``df`` (tx_id, timestamp_ms, from_addr, _g and any others)."""
    s = ranges.assign(df.withColumn("_sk", _sender_key()), out="_rng", src=S.SORT_KEY)
    has = F.col("from_addr").isNotNull().cast("bigint")
    s = running_totals(
        s, ["_sk"], "_rng", ranges.n, [F.col(S.SORT_KEY), F.col("tx_id")],
        {"_cnt": (has, True), "_cnt_prev": (has, False),
         "_sum_prev": (F.when(F.col("from_addr").isNotNull(), F.coalesce(F.col("_g"), F.lit(0.0)))
                       .otherwise(F.lit(0.0)), False)},
    )
    if snapshot is not None:
        snap = snapshot.select("from_addr", "_pre_count", "_pre_gas_sum")
        s = s.join(snap, "from_addr", "left").withColumns({
            "_cnt": F.col("_cnt") + F.coalesce("_pre_count", F.lit(0)),
            "_cnt_prev": F.col("_cnt_prev") + F.coalesce("_pre_count", F.lit(0)),
            "_sum_prev": F.col("_sum_prev") + F.coalesce("_pre_gas_sum", F.lit(0.0)),
        }).drop("_pre_count", "_pre_gas_sum")
    return s.withColumns({
        "sender_tx_count": F.col("_cnt").cast("float"),
        "sender_avg_gas": F.when(F.col("_cnt_prev") > 0, F.col("_sum_prev") / F.col("_cnt_prev").cast("double"))
                           .otherwise(F.lit(0.0)),
    }).drop("_sk", "_rng", "_g", "_cnt", "_cnt_prev", "_sum_prev")


def scalar_features(tx: DataFrame, hash_fn: str = "md5") -> DataFrame:
    """F1-F3 logs, F5 hash bins, P8 DEX flag: row-local, no shuffle."""
    d = X.cast_string_numerics(tx)
    d = X.log_features(d)
    d = d.withColumn("is_dex_candidate", X.is_dex("data_4bytes"))
    return X.categorical_hashes(d, hash_fn)


def build_features(tx: DataFrame, ranges: Ranges | None = None, hash_fn: str = "md5",
                   snapshot: DataFrame | None = None, keep: list[str] | None = None,
                   first_delta: float = 0.0) -> DataFrame:
    """All 14 features + DEX flag, keyed by tx_id (and the raw columns in ``keep``)."""
    ranges = ranges or plan_time_ranges(tx)
    base = scalar_features(tx.withColumn("_g", past_gas()), hash_fn)
    extra = [c for c in (keep or []) if c not in ("tx_id", S.SORT_KEY)]
    base = base.select("tx_id", S.SORT_KEY, *S.NUMERIC_FEATURES[:7], *S.CATEGORICAL_FEATURES, "is_dex_candidate",
                       "from_addr", "_g", *[c for c in extra if c != "from_addr"])
    out = with_time_features(with_sender_features(base, ranges, snapshot), ranges, first_delta=first_delta)
    out = out if "from_addr" in extra else out.drop("from_addr")
    S.check_blacklist(S.FEATURE_COLUMNS)
    return out
