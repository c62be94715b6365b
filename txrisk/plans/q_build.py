"""Registered queries: dataset build (features, labels, splits, snapshot, manifest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import epoch_ms
from txrisk.operators.labels import split_summary
from txrisk.plans.build import build_dataset, round_doubles
from txrisk.plans.incremental import build_increment, sender_snapshot
from txrisk.plans.registry import register
from txrisk.plans.sqltext import FEATURE_DOUBLES, dataset_sql
from txrisk.sources.sinks import write_splits
from txrisk.sources.testbind import TEST_SPLITS, TX_SQL, read_table, tx_view

DS_COLS = ["tx_id", S.SORT_KEY, "split", "row_idx", *S.FEATURE_COLUMNS, *S.LABEL_COLUMNS,
           "is_dex_candidate"]
HOUR_MS = 3_600_000
HOURLY_COLS = ["tx_id", S.SORT_KEY, "split", "row_idx", "to_addr_hash", *S.LABEL_COLUMNS, "is_dex_candidate"]
_OTHER = [c for c in DS_COLS if c not in FEATURE_DOUBLES]


HOUR_SQL = f""", CAST(count(*) OVER (ORDER BY timestamp_ms RANGE BETWEEN {HOUR_MS} PRECEDING AND 1 PRECEDING)
      + row_number() OVER (PARTITION BY timestamp_ms ORDER BY tx_id) - 1 AS FLOAT) AS hour_pressure"""


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dataset(tx_view(spark, sf_dir), TEST_SPLITS)


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed table, built once per session folder and read back (S3);
    evaluation queries prune it by split partition."""
    from txrisk.sources.sinks import materialized
    return materialized(spark, "processed", f"{sf_dir}|{TEST_SPLITS!r}", lambda: build(spark, sf_dir),
                        source=f"{sf_dir}/events.parquet", write=_write_events(spark, sf_dir))


def _write_events(spark: SparkSession, sf_dir: str):
    """Writes a table with a row for each event, which the files' footers count."""
    return lambda df, path: write_splits(df, path, rows=read_table(spark, sf_dir, "events").count())


def dataset_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed table with ``hour_pressure``, W4 over an hour: the test events
    are minutes apart, so a minute's count is nearly always 0.  Only the columns that
    strata and slices read are joined and stored."""
    from txrisk.operators.features import plan_time_ranges
    from txrisk.operators.trailing import time_order
    from txrisk.sources.sinks import materialized

    def pressed() -> DataFrame:
        tx = tx_view(spark, sf_dir)
        t = time_order(tx.select("tx_id", S.SORT_KEY), plan_time_ranges(tx), lookback_ms=HOUR_MS)
        rows = dataset(spark, sf_dir).select(*HOURLY_COLS)
        return rows.join(t.select("tx_id", F.col("pressure").cast("float").alias("hour_pressure")), "tx_id")
    return materialized(spark, "processed-hourly", f"{sf_dir}|{TEST_SPLITS!r}", pressed, source=f"{sf_dir}/events.parquet",
                        write=_write_events(spark, sf_dir))


@register("dataset_features", f"WITH {dataset_sql()} "
          f"SELECT {', '.join([f'round({c}, 6) AS {c}' for c in FEATURE_DOUBLES] + _OTHER)} FROM ds")
def q_dataset_features(spark, sf_dir):
    """The full processed table (computed, not read back)."""
    return round_doubles(build(spark, sf_dir))


_RATES = ", ".join(
    f"round(coalesce(avg(CASE WHEN {l} >= 0 THEN CAST({l} AS DOUBLE) END), 0.0), 6) AS rate_{l}"
    for l in S.LABEL_COLUMNS)


@register("split_summary", f"WITH {dataset_sql()} "
          f"SELECT coalesce(split, 'all') AS split, count(*) AS rows, {_RATES} "
          f"FROM ds GROUP BY ROLLUP (split)")
def q_split_summary(spark, sf_dir):
    """A2 + A3: rows and label rates per split and overall."""
    return round_doubles(split_summary(dataset(spark, sf_dir)))


_VAL_START = epoch_ms(TEST_SPLITS.ranges["val"][0])
_VAL_END = epoch_ms(TEST_SPLITS.ranges["val"][1])


@register("sender_snapshot", f"WITH {dataset_sql()} "
          f"SELECT from_addr, count(*) AS _pre_count, "
          f"round(sum(ln(1 + CAST(gas_price AS DOUBLE) / 1e9)), 6) AS _pre_gas_sum "
          f"FROM tx WHERE timestamp_ms < {_VAL_START} GROUP BY from_addr")
def q_sender_snapshot(spark, sf_dir):
    """A1: per-sender count and gas sum of every row before the val split."""
    return round_doubles(sender_snapshot(tx_view(spark, sf_dir), _VAL_START))


@register("incremental_val_build", f"WITH {dataset_sql()} "
          f"SELECT {', '.join([f'round({c}, 6) AS {c}' for c in FEATURE_DOUBLES] + _OTHER)} "
          f"FROM ds WHERE split = 'val'")
def q_incremental_val(spark, sf_dir):
    """The val split rebuilt alone from a sender snapshot plus a
    5-minute look-back; must equal the full build restricted to val."""
    tx = tx_view(spark, sf_dir)
    out = build_increment(tx, _VAL_START, _VAL_END, TEST_SPLITS)
    return round_doubles(out.select(*DS_COLS))


@register("snapshot_unique_senders", f"WITH {dataset_sql()} "
          f"SELECT count(DISTINCT from_addr) AS unique_senders FROM tx WHERE timestamp_ms < {_VAL_START}")
def q_snapshot_unique_senders(spark, sf_dir):
    """Distinct senders in the snapshot taken before the val split."""
    from txrisk.plans.incremental import unique_senders
    return unique_senders(sender_snapshot(tx_view(spark, sf_dir), _VAL_START))


def _tip_sql(window_ms: int) -> str:
    return f"""SELECT {window_ms // 1000} AS window_s, tx_id, p AS n_trailing, round(m, 6) AS trailing_median,
  coalesce(tip > 2.0 * m, false) AS high_tip FROM (
  SELECT tx_id, tip, p, quantile_cont(tip, 0.5) OVER (ORDER BY timestamp_ms, tx_id ROWS BETWEEN p PRECEDING AND 1 PRECEDING) AS m
  FROM (SELECT tx_id, timestamp_ms, CAST(gas_tip_cap AS DOUBLE) AS tip,
          count(*) OVER (ORDER BY timestamp_ms RANGE BETWEEN {window_ms} PRECEDING AND 1 PRECEDING)
          + row_number() OVER (PARTITION BY timestamp_ms ORDER BY tx_id) - 1 AS p FROM tx))"""


@register("trailing_median_tip", f"WITH tx AS ({TX_SQL}) {_tip_sql(60_000)} UNION ALL {_tip_sql(HOUR_MS)}")
def q_trailing_median_tip(spark, sf_dir):
    """Tips above twice the median tip of the last 60 s, and of the last hour
    (the test events are minutes apart)."""
    from txrisk.operators.features import plan_time_ranges
    from txrisk.operators.trailing import tip_above_trailing_median
    tx = tx_view(spark, sf_dir).select("tx_id", S.SORT_KEY, "gas_tip_cap")
    ranges = plan_time_ranges(tx)
    one = lambda ms: tip_above_trailing_median(tx, ranges, "gas_tip_cap", window_ms=ms).select(
        F.lit(ms // 1000).alias("window_s"), "*")
    return round_doubles(one(60_000).unionByName(one(HOUR_MS)))
