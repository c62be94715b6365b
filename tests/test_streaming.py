"""Streaming operators: duplicates and late rows (R5), windows (R2) vs batch."""

import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.conftest import SF001
from txrisk.sources.testbind import read_table, tx_from_events
from txrisk.streaming import jobs as J


def test_duplicates_and_late_rows(spark, tmp_path):
    ev = pq.read_table(f"{SF001}/events.parquet")
    src = tmp_path / "src"
    os.makedirs(src)
    # batch 0: every event, the first 50 twice; batch 2: 20 new ids far behind the watermark
    dup = pa.concat_tables([ev, ev.slice(0, 50)])
    pq.write_table(dup, src / "a.parquet")
    time.sleep(1.1)
    # late rows are judged against the previous batch's watermark: one more
    # batch (a replay of the last event) before the late file
    pq.write_table(ev.slice(ev.num_rows - 1, 1), src / "b.parquet")
    time.sleep(1.1)
    late = ev.slice(0, 20).to_pandas()
    late["event_id"] = late["event_id"] + 10_000_000
    pq.write_table(pa.Table.from_pandas(late, schema=ev.schema, preserve_index=False), src / "c.parquet")

    schema = read_table(spark, SF001, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    tx = J.dedup_stream(J.with_event_time(tx_from_events(stream))).drop("event_time")
    progress = []
    out = J.run_available_now(spark, tx, "dedup", progress=progress)
    got = spark.read.parquet(out)
    assert got.count() == ev.num_rows
    assert got.select("tx_id").distinct().count() == ev.num_rows
    assert J.late_rows_dropped(progress) == 20


def test_arrival_windows_equal_batch_counts(spark):
    from txrisk.sources.testbind import event_stream, tx_view
    stream = tx_from_events(event_stream(spark, SF001))
    out = J.run_available_now(spark, J.arrival_windows(stream), "windows", mode="update",
                              foreach_batch=J.upsert_batches)
    got = J.latest(spark, out, ["window_start_ms", "window_end_ms"])
    tx = J.with_event_time(tx_view(spark, SF001))
    exp = tx.groupBy(F.window("event_time", "60 seconds", "5 seconds").alias("w")).count() \
        .select(F.unix_millis("w.start").alias("window_start_ms"), F.col("count").alias("n"))
    diff = got.select("window_start_ms", "n").exceptAll(exp)
    assert diff.count() == 0 and got.count() == exp.count()


def test_sender_state_across_micro_batches_equals_batch(spark, tmp_path):
    """R1 with state carried over several micro-batches (files arrive in time order)."""
    from txrisk.operators.features import sender_features
    from txrisk.operators.scan import Ranges
    from txrisk.sources.testbind import tx_view
    ev = pq.read_table(f"{SF001}/events.parquet").sort_by("ts")
    src = tmp_path / "src"
    os.makedirs(src)
    n = ev.num_rows
    for i, (a, b) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]):
        pq.write_table(ev.slice(a, b - a), src / f"part{i}.parquet")
        time.sleep(1.1)
    schema = read_table(spark, SF001, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    progress = []
    out = J.run_available_now(spark, J.sender_state_stream(tx_from_events(stream)), "r1", progress=progress)
    assert len([p for p in progress if p["numInputRows"] > 0]) == 3
    got = spark.read.parquet(out).toPandas().set_index("tx_id").sort_index()
    exp = sender_features(tx_view(spark, SF001), Ranges("timestamp_ms", (-float("inf"), float("inf")))) \
        .toPandas().set_index("tx_id").sort_index()
    assert (got["sender_tx_count"] == exp["sender_tx_count"]).all()
    assert ((got["sender_avg_gas"] - exp["sender_avg_gas"]).abs() < 1e-9).all()


def test_sender_batches_equal_batch_with_a_hot_sender(spark, tmp_path, monkeypatch):
    """R1 by ranged scans: one sender owns over half of the rows, state passes through whole tables."""
    from txrisk.operators.features import sender_features
    from txrisk.operators.scan import Ranges
    from txrisk.plans.incremental import sender_snapshot
    monkeypatch.setattr(J, "COMPACT", 2)
    rows = [(i, 1_000_000 + 10 * (i // 2), None if i % 11 == 0 else "hot" if i % 7 < 4 else f"s{i % 5}",
             None if i % 13 == 0 else str(10**9 * (1 + i % 17))) for i in range(400)]
    tx = spark.createDataFrame(rows, "tx_id long, timestamp_ms long, from_addr string, gas_price string")
    src, edges = str(tmp_path / "src"), [1_000_000, 1_000_400, 1_000_800, 1_001_200, 1_001_600, 1_002_000]
    for a, b in zip(edges[1:-1], edges[2:]):
        tx.where(f"timestamp_ms >= {a} AND timestamp_ms < {b}").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(src)
    writer = J.sender_state_batches(sender_snapshot(tx, edges[1]), rows_per_range=20)
    out = J.run_available_now(spark, stream, "r1b", foreach_batch=writer)
    assert os.path.exists(f"{out}/whole/batch=1") and len(os.listdir(f"{out}/added")) == 4
    before = J.sender_rows(spark, out).orderBy("tx_id").collect()
    writer(tx.where(f"timestamp_ms >= {edges[4]}"), 3, out)  # a retried batch writes the same
    got = J.sender_rows(spark, out).toPandas().set_index("tx_id").sort_index()
    assert [tuple(r) for r in before] == [tuple(r) for r in got.reset_index().itertuples(index=False)]
    exp = sender_features(tx, Ranges("timestamp_ms", (-float("inf"), float("inf")))) \
        .where("tx_id >= 80").toPandas().set_index("tx_id").sort_index()
    assert (got["sender_tx_count"] == exp["sender_tx_count"]).all() and len(got) == len(exp) == 320
    assert ((got["sender_avg_gas"] - exp["sender_avg_gas"]).abs() < 1e-9).all()
