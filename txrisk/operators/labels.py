"""Outcome labels (F6-F9), time splits (P15) and split statistics (A2, A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions import scalar as X
from txrisk.schema import SplitRanges


def with_labels(df: DataFrame, splits: SplitRanges = SplitRanges(),
                censor: bool = True) -> DataFrame:
    """is_reverted / is_mev_victim / is_dropped in {-1, 0, 1} (float).

    ``is_dropped`` is right-censored to -1 when ts > capture_end - maturity.
    """
    cutoff = None
    if censor and splits.capture_end:
        cutoff = X.epoch_ms(splits.capture_end) - splits.maturity_hours * 3_600_000
    return df.withColumns({
        "is_reverted": X.label_is_reverted(),
        "is_mev_victim": X.label_is_mev_victim(),
        "is_dropped": X.label_is_dropped(cutoff_ms=cutoff),
    })


def split_column(splits: SplitRanges = SplitRanges(), ts: str = S.SORT_KEY) -> F.Column:
    """Name of the half-open range holding ts, NULL if none."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(list(splits.ranges.items())):
        lo, hi = X.epoch_ms(a), X.epoch_ms(b)
        out = F.when((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi)), F.lit(name)).otherwise(out)
    return out


def assign_split(df: DataFrame, splits: SplitRanges = SplitRanges(), ts: str = S.SORT_KEY) -> DataFrame:
    """Add ``split``; rows outside every range are dropped."""
    return df.withColumn("split", split_column(splits, ts)).where(F.col("split").isNotNull())


def label_rate(label: str) -> F.Column:
    """A2: mean over valid (>= 0) rows, 0.0 if there are none."""
    return F.coalesce(F.avg(F.when(F.col(label) >= 0, F.col(label).cast("double"))), F.lit(0.0))


def split_summary(df: DataFrame, labels=S.LABEL_COLUMNS) -> DataFrame:
    """A2 + A3 in one pass: rows and label rates per split plus an 'all' row (rollup)."""
    agg = df.rollup("split").agg(
        F.count(F.lit(1)).alias("rows"),
        *[label_rate(l).alias(f"rate_{l}") for l in labels],
        F.grouping_id().alias("_g"),
    )
    return agg.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("split")).alias("split"),
                      "rows", *[f"rate_{l}" for l in labels])
