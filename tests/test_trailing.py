"""Trailing windows by halo against a loop: ties, bursts, a crowded millisecond, many ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators.features import plan_time_ranges
from txrisk.operators.trailing import ValueCounts, tip_above_trailing_median, time_order

SHAPES = {
    "sparse": lambda rng, n: rng.integers(0, 3_000_000, n),
    "ties": lambda rng, n: rng.integers(0, 40, n) * 7_000,
    "burst": lambda rng, n: np.where(np.arange(n) < n // 2, 500_000 + rng.integers(0, 30, n), rng.integers(0, 900_000, n)),
    "crowded": lambda rng, n: np.where(np.arange(n) < 2 * n // 3, 400_000, rng.integers(0, 900_000, n)),
}


def brute(pdf, lookback):
    pdf = pdf.sort_values(["timestamp_ms", "tx_id"]).reset_index(drop=True)
    t, tip = pdf.timestamp_ms.to_numpy(), pdf.tip.to_numpy()
    out = {}
    for i in range(len(pdf)):
        a = i
        while a > 0 and t[a - 1] >= t[i] - lookback:
            a -= 1
        seen = tip[a:i][~np.isnan(tip[a:i])]
        out[int(pdf.tx_id[i])] = (i, int(t[i - 1]) if i else None, i - a, float(np.median(seen)) if len(seen) else None)
    return out


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("rows_per_range", [10**9, 25])
def test_against_a_loop(spark, shape, rows_per_range):
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({"tx_id": rng.permutation(n), "timestamp_ms": SHAPES[shape](rng, n),
                        "tip": np.round(rng.exponential(size=n), 1), "note": [f"n{i}" for i in range(n)]})
    pdf.loc[::9, "tip"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("tip", F.nanvl("tip", F.lit(None))).repartition(3)
    ranges = plan_time_ranges(df, rows_per_range)
    assert (ranges.n > 5) == (rows_per_range == 25)
    got = time_order(df, ranges, lookback_ms=60_000, median_of="tip").collect()
    want = brute(pdf, 60_000)
    assert {r.tx_id: (r.row_idx, r.prev_ts, r.pressure, r.trailing_median) for r in got} == want
    notes = dict(zip(pdf.tx_id, pdf.note))
    assert all(r.note == notes[r.tx_id] for r in got)  # other columns travel along
    flags = {r.tx_id: r.high_tip for r in tip_above_trailing_median(df, ranges, "tip").collect()}
    for i, tip in zip(pdf.tx_id, pdf.tip):
        m = want[i][3]
        assert flags[i] == (m is not None and not np.isnan(tip) and tip > 2 * m)


def test_halo_of_a_burst_is_bounded(spark):
    """A millisecond with most of the rows is one weighted halo row for each later range."""
    from txrisk.operators.trailing import _halo
    df = spark.range(5000).select(F.col("id").alias("tx_id"), F.when(F.col("id") < 4000, 1000)
                                  .otherwise(F.col("id")).cast("long").alias("timestamp_ms"))
    ranges = plan_time_ranges(df, 100)
    halo = _halo(ranges.assign(df, "_rng", "timestamp_ms", "tx_id"), ranges, "timestamp_ms", [], 60_000)
    per = halo.groupBy("_rng").agg(F.count(F.lit(1)).alias("n"), F.max("_w").alias("w")).agg(F.max("n"), F.max("w")).first()
    assert per[0] <= 1100 and ranges.n > 20


def test_value_counts_against_sorted_list():
    rng = np.random.default_rng(2)
    box, held = ValueCounts(), []
    for _ in range(6000):
        if held and rng.random() < 0.45:
            x = held.pop(int(rng.integers(len(held))))
            box.add(x, -1)
        else:
            x = float(rng.integers(0, 3000))
            box.add(x, 1)
            held.append(x)
        if rng.random() < 0.05:
            assert box.median() == (float(np.median(held)) if held else None)
