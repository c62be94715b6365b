"""Edge fixtures: sequence lengths, constant strata, degenerate Δt bins, NULL gas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import sequences as Q
from txrisk.operators.slices import with_strata


@pytest.mark.parametrize("n,L", [(5, 8), (8, 8), (8 * 3 + 5, 8)])
def test_window_lengths(spark, n, L):
    """N < L -> one short window; N = L -> one; N = kL + r -> k windows, tail dropped."""
    df = spark.range(n).select(F.col("id").alias("_i"), F.col("id").alias("tx_id"),
                               F.lit(0.0).alias("is_mev_victim"))
    rows = Q.window_rows(df, L, warmup=2)
    s = Q.window_summary(rows).orderBy("window_id").toPandas()
    k = max(1, (n - L) // L + 1)
    assert list(s["window_id"]) == list(range(k))
    assert list(s["n_rows"]) == [min(L, n)] * k
    assert list(s["n_mask"]) == [max(0, min(L, n) - 2)] * k


@pytest.mark.parametrize("n,L,stride", [(23, 8, 3), (23, 8, 11), (5, 8, 3), (24, 8, 8), (23, 8, 8)])
@pytest.mark.parametrize("tail", [False, True])
def test_strided_windows(spark, n, L, stride, tail):
    df = spark.range(n).select(F.col("id").alias("_i"))
    got = {tuple(r) for r in Q.window_rows(df, L, warmup=2, stride=stride, keep_tail=tail)
           .select("window_id", "pos", "_i", "mask").collect()}
    k = -(-n // stride) if tail else max(1, (n - L) // stride + 1)
    assert got == {(w, i - w * stride, i, i - w * stride >= 2)
                   for w in range(k) for i in range(w * stride, min(w * stride + L, n))}
    if tail and stride <= L:
        assert {g[2] for g in got} == set(range(n))


def test_stored_table_follows_its_source(spark, tmp_path):
    from txrisk.sources.sinks import materialized
    src = str(tmp_path / "src.parquet")

    def stored():
        return {r[0] for r in materialized(spark, "edge", "k", lambda: spark.read.parquet(src), source=src).collect()}

    spark.range(3).write.parquet(src)
    assert stored() == stored() == {0, 1, 2}
    spark.range(3, 5).write.mode("append").parquet(src)
    assert stored() == {0, 1, 2, 3, 4}


def test_constant_pressure_goes_to_top_stratum(spark):
    df = spark.createDataFrame([(i, 7.0) for i in range(20)], "tx_id long, mempool_pressure double")
    got = {r[0] for r in with_strata(df, "mempool_pressure", [0.25, 0.5, 0.75], "q", offset=1)
           .select("q").collect()}
    exp = set(np.clip(np.digitize(np.full(20, 7.0), np.percentile(np.full(20, 7.0), [25, 50, 75])) + 1, 1, 4))
    assert got == exp == {4}


def _np_bins(d):
    d = np.asarray(d, dtype=float)
    v = d[d > 0] if (d > 0).any() else d
    e = np.percentile(v, [25, 50, 75]).astype(np.float32)
    b = np.digitize(v, e)
    m = [np.median(v[b == i]) if (b == i).any() else np.median(v) for i in range(4)]
    return [float(x) for x in e], [float(np.float32(x)) for x in m]


@pytest.mark.parametrize("deltas", [[0.0] * 9, [0, 0, 1, 1, 1, 1, 1, 2, 300], list(np.linspace(0.001, 5, 37))])
def test_delta_bins_degenerate(spark, deltas):
    df = spark.createDataFrame(pd.DataFrame({"timestamp_delta_s": np.asarray(deltas, dtype=float)}))
    got = Q.delta_bins(df)
    e, m = _np_bins(deltas)
    np.testing.assert_allclose(got["edges"], e, rtol=1e-7)
    np.testing.assert_allclose(got["medians"], m, rtol=1e-7)


def test_null_gas_counts_but_adds_nothing(spark):
    from tests.test_features import _tx
    from txrisk.operators.features import build_features
    from txrisk.operators.scan import Ranges
    rows = [(1, 1000, "a", "1000000000"), (2, 2000, "a", None), (3, 3000, "a", "3000000000")]
    got = build_features(_tx(spark, rows), Ranges("timestamp_ms", (-np.inf, np.inf))) \
        .orderBy("tx_id").toPandas()
    assert list(got["sender_tx_count"]) == [1.0, 2.0, 3.0]
    # row 3 averages the two earlier rows; the NULL contributes 0 to the sum
    assert got["sender_avg_gas"].iloc[2] == pytest.approx(np.log1p(1.0) / 2)
    assert np.isnan(got["log_gas_price"].iloc[1]) or got["log_gas_price"].isna().iloc[1]
