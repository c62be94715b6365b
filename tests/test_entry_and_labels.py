"""Driver contract, label edges, incremental build and the streaming twin."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.functions.scalar import epoch_ms, label_is_dropped, label_is_reverted
from txrisk.operators.labels import assign_split, split_summary
from txrisk.schema import SplitRanges


def test_entry_runs_and_has_stable_schema(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and {r["split"] for r in rows} == {"train", "val", "test", "all"}
    assert df.columns == ["split", "rows", "rate_is_reverted", "rate_is_mev_victim", "rate_is_dropped"]
    assert set(E.queries()) >= set(E.oracle_sql())


def test_maturity_edge_and_receipt_labels(spark):
    cutoff = 1_000
    df = spark.createDataFrame(
        [(1000, None, None), (1001, None, None), (10, 0, None), (10, 5, None), (10, None, 1)],
        "timestamp_ms long, included_at_block_height long, receipt_status long")
    got = [r[0] for r in df.select(label_is_dropped(cutoff_ms=cutoff)).collect()]
    assert got == [1.0, -1.0, 1.0, 0.0, 0.0]
    rs = spark.createDataFrame([(None,), (0,), (1,)], "receipt_status long")
    assert [r[0] for r in rs.select(label_is_reverted()).collect()] == [-1.0, 1.0, 0.0]


def test_split_edges(spark):
    sp = SplitRanges(ranges={"a": ("2024-01-01", "2024-01-02"), "b": ("2024-01-02", "2024-01-03")})
    t0, t1, t2 = epoch_ms("2024-01-01"), epoch_ms("2024-01-02"), epoch_ms("2024-01-03")
    df = spark.createDataFrame([(t0,), (t1 - 1,), (t1,), (t2,), (t0 - 1,)], "timestamp_ms long")
    got = sorted((r[0], r[1]) for r in assign_split(df, sp).collect())
    assert got == [(t0, "a"), (t1 - 1, "a"), (t1, "b")]


def test_label_rate_zero_without_valid_rows(spark):
    df = spark.createDataFrame([("x", -1.0, 0.0, -1.0)],
                               "split string, is_reverted float, is_mev_victim float, is_dropped float")
    r = split_summary(df).where(F.col("split") == "x").first()
    assert r["rate_is_reverted"] == 0.0 and r["rows"] == 1


@pytest.mark.parametrize("name", ["incremental_val_build", "stream_sender_state"])
def test_incremental_and_stream_equal_full_build(spark, name):
    import duckdb
    import __spark_entry__ as E
    got = E.queries()[name](spark, SF001).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF001}/events.parquet')")
    exp = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(exp.columns)
    a = got[cols].sort_values("tx_id").reset_index(drop=True)
    b = exp[cols].sort_values("tx_id").reset_index(drop=True)
    assert len(a) == len(b) and len(a) > 0
    for c in cols:
        if a[c].dtype.kind in "fiu":
            assert (a[c].astype(float).round(6) == b[c].astype(float).round(6)).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_manifest_and_stores_roundtrip(spark, tmp_path):
    from txrisk.sources import sinks
    df = spark.createDataFrame([("train", 1.0, 0.0, -1.0), ("val", 0.0, 1.0, 0.0)],
                               "split string, is_reverted float, is_mev_victim float, is_dropped float")
    doc = sinks.write_manifest(sinks.manifest_frame(df), str(tmp_path / "manifest"))
    assert doc["total_rows"] == 2 and doc["splits"]["train"]["label_rates"]["is_dropped"] == 0.0
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "manifest")).collect())
    assert '"feature_hash"' in text
    m = spark.createDataFrame([("r", "auc", 0.5)], "run_id string, metric string, value double")
    sinks.upsert_metrics(m, str(tmp_path / "metrics"))
    sinks.upsert_metrics(m.withColumn("value", F.lit(0.7)), str(tmp_path / "metrics"))
    got = sinks.latest_metrics(spark, str(tmp_path / "metrics")).collect()
    assert len(got) == 1 and got[0]["value"] == 0.7
    with pytest.raises(FileNotFoundError):
        s = spark.createDataFrame([("a", 1, 0.1)], "run_id string, tx_id long, mev_score double")
        sinks.write_scores(s.withColumn("split", F.lit("test")), str(tmp_path / "scores"))
        sinks.read_scores(spark, str(tmp_path / "scores"), "missing")


def test_identity_ablation_and_cached_scores(spark, tmp_path):
    from txrisk.functions.scalar import ablate
    from txrisk.plans.evaluate import scores_or_compute
    df = spark.createDataFrame([(1, 5, 7, 9, 0.5)], "tx_id long, from_addr_hash long, to_addr_hash long, "
                               "data_4bytes_hash long, log_gas double")
    r = ablate(df).first()
    assert (r["from_addr_hash"], r["to_addr_hash"], r["data_4bytes_hash"], r["log_gas"]) == (0, 0, 0, 0.5)
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, 0.3)], "tx_id long, mev_score double")
    path = str(tmp_path / "scores")
    a = scores_or_compute(spark, path, "run1", "val", compute).count()
    b = scores_or_compute(spark, path, "run1", "val", compute).count()
    assert a == b == 1 and len(calls) == 1


def test_run_build_and_evaluation_end_to_end(spark, tmp_path):
    """S1 raw read with an explicit schema -> build -> audit -> split table ->
    manifest; then every evaluation table for a score run."""
    from txrisk.plans.build import run_build
    from txrisk.plans.evaluate import run_evaluation
    from txrisk.sources.testbind import TEST_SPLITS, blend_scores, tx_view
    raw = str(tmp_path / "raw")
    tx_view(spark, SF001).write.parquet(raw)
    out = str(tmp_path / "processed")
    doc = run_build(spark, raw, out, TEST_SPLITS, audit=True, on_fail="warn")
    assert doc["total_rows"] == 1000 and set(doc["splits"]) == {"train", "val", "test"}
    assert doc["leakage_audit"] in ("passed", "FAILED")
    ds = spark.read.parquet(out)
    scores = blend_scores(ds.where(F.col("split") == "test"), "blend_a", 0.5)
    run_evaluation(spark, scores, ds, str(tmp_path / "eval"), reps=20)
    m = spark.read.parquet(str(tmp_path / "eval" / "metrics"))
    assert m.where(F.col("metric") == "revert_auc").count() == 1
    assert spark.read.parquet(str(tmp_path / "eval" / "dex_subset")).count() == 3


def test_incremental_equals_full_with_many_ranges(spark):
    from txrisk.functions.scalar import epoch_ms
    from txrisk.plans.build import build_dataset
    from txrisk.plans.incremental import build_increment
    from txrisk.sources.testbind import TEST_SPLITS, tx_view
    tx = tx_view(spark, SF001)
    a, b = epoch_ms("2024-01-23"), epoch_ms("2024-01-27")
    full = build_dataset(tx, TEST_SPLITS, rows_per_range=60).where(F.col("split") == "val")
    inc = build_increment(tx, a, b, TEST_SPLITS, rows_per_range=15).select(*full.columns)
    cols = ["tx_id", "row_idx", "timestamp_delta_s", "mempool_pressure", "sender_tx_count",
            "sender_avg_gas", "is_dropped"]
    x = full.select(*cols).toPandas().set_index("tx_id").sort_index()
    y = inc.select(*cols).toPandas().set_index("tx_id").sort_index()
    assert len(x) == len(y) > 0
    pd.testing.assert_frame_equal(x, y, check_exact=False, rtol=1e-12)


def test_raw_scan_prunes_and_pushes_time_filter(spark, tmp_path):
    """The half-open time filter reaches the parquet scan and only the
    needed columns are read."""
    from txrisk.sources.raw import read_raw
    from txrisk.sources.testbind import tx_view
    raw = str(tmp_path / "raw")
    tx_view(spark, SF001).write.parquet(raw)
    df = read_raw(spark, raw, start_ms=1704067200000, end_ms=1704153600000).select("tx_id", "gas_price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp_ms), GreaterThanOrEqual(timestamp_ms" in plan
    assert "LessThan(timestamp_ms" in plan
    assert "ReadSchema: struct<tx_id:bigint,timestamp_ms:bigint,gas_price:string>" in plan


def test_split_table_layout_is_time_sorted(spark, tmp_path):
    """One folder per split; rows inside every file sorted by time."""
    import glob
    import pyarrow.parquet as pq
    from txrisk.plans.build import build_dataset
    from txrisk.sources.sinks import write_splits
    from txrisk.sources.testbind import TEST_SPLITS, tx_view
    out = str(tmp_path / "processed")
    write_splits(build_dataset(tx_view(spark, SF001), TEST_SPLITS), out)
    dirs = sorted(os.path.basename(d) for d in glob.glob(f"{out}/split=*"))
    assert dirs == ["split=test", "split=train", "split=val"]
    for f in glob.glob(f"{out}/split=*/*.parquet"):
        ts = pq.read_table(f, columns=["timestamp_ms"]).column(0).to_pylist()
        assert ts == sorted(ts)
