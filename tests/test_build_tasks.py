"""A task of the build holds one range of rows, however few partitions the session's shuffles have."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from txrisk.operators.scan import plan_ranges, running_totals
from txrisk.operators.trailing import time_order
from txrisk.sources import sinks


def _rows(spark, n=2400):
    return spark.range(n).select(F.col("id").alias("tx_id"), (F.col("id") * 1000).alias("timestamp_ms"),
                                 (F.col("id") % 7).alias("k"), F.lit(1.0).alias("v"))


def test_each_range_has_a_task(spark):
    d = _rows(spark)
    ranges = plan_ranges(d, "timestamp_ms", 100, tiebreak="tx_id")
    assert ranges.n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = time_order(d, ranges).withColumn("task", F.spark_partition_id())
    t = ranges.assign(t, "r", "timestamp_ms", "tx_id")
    assert t.groupBy("task").agg(F.countDistinct("r").alias("n")).agg(F.max("n")).first()[0] == 1
    assert t.where("row_idx <> tx_id OR pressure <> least(tx_id, 60)").count() == 0


def test_running_totals_use_a_task_for_each_range(spark):
    d = _rows(spark)
    ranges = plan_ranges(d, "timestamp_ms", 100, tiebreak="tx_id")
    out = running_totals(ranges.assign(d), ["k"], "_rng", ranges.n, [F.col("timestamp_ms")],
                         {"up": (F.col("v"), True)}, totals={"whole": "up"})
    assert out.rdd.getNumPartitions() >= ranges.n
    assert out.where("up <> floor(tx_id / 7) + 1").count() == 0
    assert out.where("whole <> floor((2399 - k) / 7) + 1").count() == 0


def test_a_large_table_is_written_by_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TIME_ROWS_PER_RANGE", 100)
    d = _rows(spark).withColumn("split", F.lit("train"))
    sinks.write_splits(d, str(tmp_path / "t"), rows=2400)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "t").rglob("*.parquet")]
    assert sum(sizes) == 2400 and max(sizes) < 200
    sinks.write_splits(d, str(tmp_path / "few"), rows=300)
    assert len(list((tmp_path / "few").rglob("*.parquet"))) <= 8
