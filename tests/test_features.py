"""Feature operators against numpy brute force, causality and partition invariance."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk import schema as S
from txrisk.operators.features import build_features, plan_time_ranges, time_features
from txrisk.operators.scan import Ranges
from txrisk.sources.testbind import tx_view


def _tx(spark, rows):
    """Raw-schema frame from (tx_id, ts, from_addr, gas_price) tuples."""
    pdf = pd.DataFrame(rows, columns=["tx_id", "timestamp_ms", "from_addr", "gas_price"])
    df = spark.createDataFrame(pdf, "tx_id long, timestamp_ms long, from_addr string, gas_price string")
    for c in ["gas_tip_cap", "gas_fee_cap", "value", "gas", "nonce", "to_addr", "data_4bytes", "mev_type"]:
        df = df.withColumn(c, F.lit("1") if c not in ("to_addr", "data_4bytes", "mev_type") else F.lit(None).cast("string"))
    return (df.withColumn("data_size", F.lit(1).cast("bigint"))
              .withColumn("receipt_status", F.lit(1).cast("bigint"))
              .withColumn("included_at_block_height", F.lit(5).cast("bigint")))


def _brute(rows, window=60_000):
    pdf = pd.DataFrame(rows, columns=["tx_id", "ts", "from_addr", "gas"]).sort_values(["ts", "tx_id"])
    ts = pdf["ts"].to_numpy()
    pdf["pressure"] = np.arange(len(ts)) - np.searchsorted(ts, ts - window, side="left")
    d = np.diff(ts, prepend=ts[0]) / 1000.0
    pdf["delta"] = np.clip(d, 0, 300)
    pdf["idx"] = np.arange(len(ts))
    g = np.log1p(pdf["gas"].astype(float) / 1e9)
    pdf["g"] = g
    cnt, avg = [], []
    state = {}
    for a, gv in zip(pdf["from_addr"], pdf["g"]):
        if a is None:
            cnt.append(0.0)
            avg.append(0.0)
            continue
        c, s = state.get(a, (0, 0.0))
        avg.append(s / c if c else 0.0)
        cnt.append(c + 1.0)
        state[a] = (c + 1, s + gv)
    pdf["cnt"], pdf["avg"] = cnt, avg
    return pdf.set_index("tx_id")


def _fixture():
    # ties in time, gaps > 300 s, rows exactly 60 000 and 60 001 ms apart, a null
    # sender, and one hot sender owning most rows
    rng = np.random.default_rng(7)
    rows, t = [], 1_000_000
    for i in range(400):
        t += int(rng.choice([0, 0, 1, 500, 60_000, 60_001, 400_000]))
        sender = None if i == 17 else ("hot" if rng.random() < 0.6 else f"s{i % 9}")
        rows.append((1000 - i if i % 3 else i, t, sender, str(int(rng.integers(1, 10**11)))))
    return rows


@pytest.mark.parametrize("rows_per_range", [10**9, 37])
def test_time_and_sender_features_match_brute_force(spark, rows_per_range):
    rows = _fixture()
    tx = _tx(spark, rows)
    ranges = plan_time_ranges(tx, rows_per_range)
    if rows_per_range == 37:
        assert ranges.n > 3  # several ranges -> carried totals path
    got = build_features(tx, ranges).toPandas().set_index("tx_id").sort_index()
    exp = _brute(rows).sort_index()
    np.testing.assert_array_equal(got["row_idx"], exp["idx"])
    np.testing.assert_array_equal(got["mempool_pressure"], exp["pressure"].astype("float32"))
    np.testing.assert_allclose(got["timestamp_delta_s"], exp["delta"])
    np.testing.assert_array_equal(got["sender_tx_count"], np.array(exp["cnt"], dtype="float32"))
    np.testing.assert_allclose(got["sender_avg_gas"], exp["avg"], rtol=1e-12)


def test_causality_features_ignore_later_rows(spark):
    rows = _fixture()
    cut = sorted(r[1] for r in rows)[250]
    early = [r for r in rows if r[1] <= cut]
    full = build_features(_tx(spark, rows), Ranges("timestamp_ms", (-np.inf, np.inf))).toPandas()
    part = build_features(_tx(spark, early), Ranges("timestamp_ms", (-np.inf, np.inf))).toPandas()
    cols = ["timestamp_delta_s", "mempool_pressure", "sender_tx_count", "sender_avg_gas", "row_idx"]
    a = full.set_index("tx_id").loc[part["tx_id"], cols].sort_index()
    b = part.set_index("tx_id")[cols].sort_index()
    pd.testing.assert_frame_equal(a, b)


def test_partition_invariance_on_events(spark):
    tx = tx_view(spark, SF001)
    a = time_features(tx, plan_time_ranges(tx)).toPandas().set_index("tx_id").sort_index()
    b = time_features(tx.repartition(7), plan_time_ranges(tx, 50)).toPandas().set_index("tx_id").sort_index()
    pd.testing.assert_frame_equal(a, b)


def test_blacklist_guard():
    with pytest.raises(ValueError):
        S.check_blacklist(["log_gas", "receipt_status"])


def test_strict_cast_raises_on_malformed_text(spark):
    from txrisk.functions.scalar import cast_string_numerics
    ok = spark.createDataFrame([("115792089237316195423570985008687907853269984665640564039457584007913129639935",)],
                               "value string")
    v = cast_string_numerics(ok, ["value"]).first()[0]
    assert abs(v - 1.157920892373162e77) / 1e77 < 1e-12
    bad = spark.createDataFrame([("12x",)], "value string")
    with pytest.raises(Exception):
        cast_string_numerics(bad, ["value"]).collect()
    assert cast_string_numerics(bad, ["value"], strict=False).first()[0] is None


def test_hot_millisecond_is_split_and_exact(spark):
    """One instant holds most rows: it gets its own range, cut by tx_id."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        ts = 5_000_000 if i % 8 < 5 else 5_000_000 + int(rng.integers(-200_000, 200_000))
        sender = "hot" if i % 3 else f"s{i % 5}"
        rows.append((int(rng.permutation(10_000)[0]) * 1000 + i, ts, sender, str(int(rng.integers(1, 10**11)))))
    tx = _tx(spark, rows)
    ranges = plan_time_ranges(tx, 30)
    assert ranges.heavy and len(ranges.heavy[0][1]) >= 2  # the hot instant is cut
    got = build_features(tx, ranges).toPandas().set_index("tx_id").sort_index()
    exp = _brute(rows).sort_index()
    np.testing.assert_array_equal(got["row_idx"], exp["idx"])
    np.testing.assert_array_equal(got["mempool_pressure"], exp["pressure"].astype("float32"))
    np.testing.assert_allclose(got["timestamp_delta_s"], exp["delta"])
    np.testing.assert_array_equal(got["sender_tx_count"], np.array(exp["cnt"], dtype="float32"))
    np.testing.assert_allclose(got["sender_avg_gas"], exp["avg"], rtol=1e-12)
    parts = ranges.assign(tx, "_r", "timestamp_ms").groupBy("_r").count().toPandas()
    assert parts["count"].max() < 250  # no range holds the whole instant
