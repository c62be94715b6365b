"""Registered queries: Structured Streaming jobs run to completion (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import epoch_ms
from txrisk.plans.build import round_doubles
from txrisk.plans.incremental import sender_snapshot
from txrisk.plans.q_build import dataset  # noqa: F401
from txrisk.plans.q_metrics import rule_thresholds
from txrisk.plans.registry import register
from txrisk.plans.sqltext import dataset_sql
from txrisk.sources.testbind import (DAY_S, TEST_SPLITS, TX_SQL, event_stream, inclusion_events, notice_delay_sql,
                                    tx_from_events, tx_view)
from txrisk.streaming import jobs as J

_VAL_START = epoch_ms(TEST_SPLITS.ranges["val"][0])


@register("stream_sender_state", f"""WITH {dataset_sql()}
SELECT tx_id, sender_tx_count, round(sender_avg_gas, 6) AS sender_avg_gas FROM feat
WHERE timestamp_ms >= {_VAL_START}""")
def q_stream_sender_state(spark, sf_dir):
    """R1 (+A1 seed): sender running state on the stream from the val start,
    seeded with the snapshot of all earlier rows; equals batch W2/W3."""
    snap = sender_snapshot(tx_view(spark, sf_dir), _VAL_START)
    stream = tx_from_events(event_stream(spark, sf_dir)).where(F.col(S.SORT_KEY) >= F.lit(_VAL_START))
    out = J.run_available_now(spark, J.sender_state_stream(stream, snap), "sender_state")
    return round_doubles(spark.read.parquet(out))


@register("stream_sender_batches", f"""WITH {dataset_sql()}
SELECT tx_id, sender_tx_count, round(sender_avg_gas, 6) AS sender_avg_gas FROM feat
WHERE timestamp_ms >= {_VAL_START}""")
def q_stream_sender_batches(spark, sf_dir):
    """R1 by ranged scans per micro-batch (no Python worker holds a sender's rows): the rows from
    the val start arrive in time order in three deliveries, after a snapshot of all earlier ones."""
    import os
    import uuid
    from txrisk.session import checkpoint_dir
    path = os.path.join(checkpoint_dir(spark), "arrivals", uuid.uuid4().hex)
    tx = tx_view(spark, sf_dir).select("tx_id", S.SORT_KEY, "from_addr", "gas_price")
    late = tx.where(F.col(S.SORT_KEY) >= F.lit(_VAL_START))
    lo, hi = late.agg(F.min(S.SORT_KEY), F.max(S.SORT_KEY)).first()
    third = F.lit(0) if lo is None else F.floor((F.col(S.SORT_KEY) - lo) * 3 / F.lit(hi - lo + 1)).cast("int")
    for i in range(3):
        late.where(third == i).repartition(4).write.mode("append").parquet(path)  # four files are one delivery
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = J.run_available_now(spark, stream, "sender_batches",
                              foreach_batch=J.sender_state_batches(sender_snapshot(tx, _VAL_START)))
    return round_doubles(J.sender_rows(spark, out))


@register("stream_arrival_windows", f"""WITH tx AS ({TX_SQL}),
w AS (SELECT (timestamp_ms // 5000) * 5000 - r.k * 5000 AS ws FROM tx CROSS JOIN range(12) AS r(k))
SELECT ws AS window_start_ms, ws + 60000 AS window_end_ms, count(*) AS n FROM w GROUP BY ws""")
def q_stream_arrival_windows(spark, sf_dir):
    """R2: 60 s windows sliding by 5 s over event time, watermark 10 min,
    update mode upserted through foreachBatch."""
    stream = tx_from_events(event_stream(spark, sf_dir))
    out = J.run_available_now(spark, J.arrival_windows(stream), "arrival_windows", mode="update",
                              foreach_batch=J.upsert_batches)
    return J.latest(spark, out, ["window_start_ms", "window_end_ms"])


@register("stream_triage_top100", f"""WITH {dataset_sql()},
thr AS (SELECT quantile_cont(log_gas_tip, 0.5) AS tip_m FROM ds WHERE split = 'train'),
s AS (SELECT tx_id, CAST(data_4bytes_hash <> 0 AND CAST(log_gas_tip AS FLOAT) > CAST(2.0 * tip_m AS FLOAT) AS FLOAT)
        AS mev_score FROM feat, thr)
SELECT tx_id, mev_score FROM s ORDER BY mev_score DESC, tx_id LIMIT 100""")
def q_stream_triage(spark, sf_dir):
    """R4 + R5: de-duplicated arrivals scored by the rule model on arrival;
    the 100 highest MEV scores over all micro-batches (a top-k report)."""
    thr = rule_thresholds(spark, sf_dir)
    stream = tx_from_events(event_stream(spark, sf_dir))
    out = J.run_available_now(spark, J.triage_stream(stream, thr), "triage",
                              foreach_batch=J.top_k_per_batch(100))
    return J.merged_top_k(spark, out, 100).select("tx_id", "mev_score")


@register("stream_outcome", f"""WITH tx AS ({TX_SQL}),
m AS (SELECT max(timestamp_ms) - 25 * 3600000 AS cutoff FROM tx)
SELECT tx_id, timestamp_ms,
  CAST(CASE WHEN ((included_at_block_height = 0 OR included_at_block_height IS NULL) AND receipt_status IS NULL)
              OR {notice_delay_sql()} > {DAY_S} THEN 1 ELSE 0 END AS FLOAT) AS is_dropped_stream
FROM tx, m WHERE timestamp_ms < cutoff""")
def q_stream_outcome(spark, sf_dir):
    """R3 (+F8, F9 as a stream): left outer interval join of arrivals with
    inclusion notices inside 24 h (some come just before, at or after them); every transaction whose 24 h horizon lies
    behind the watermark (1 h) is settled, the rest stays in state (censored)."""
    tx = tx_from_events(event_stream(spark, sf_dir))
    inc = inclusion_events(tx_from_events(event_stream(spark, sf_dir)))
    out = J.run_available_now(spark, J.outcome_stream(tx, inc), "outcome")
    cutoff = tx_view(spark, sf_dir).agg(F.max(S.SORT_KEY)).first()[0] - 25 * 3_600_000
    return spark.read.parquet(out).where(F.col(S.SORT_KEY) < F.lit(cutoff))


@register("stream_sender_sessions", f"""WITH tx AS ({TX_SQL}),
s AS (SELECT from_addr, timestamp_ms, tx_id,
        CASE WHEN timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY from_addr ORDER BY timestamp_ms, tx_id)
             < 1800000 THEN 0 ELSE 1 END AS brk FROM tx WHERE from_addr IS NOT NULL),
g AS (SELECT *, sum(brk) OVER (PARTITION BY from_addr ORDER BY timestamp_ms, tx_id ROWS UNBOUNDED PRECEDING)
        AS sid FROM s),
ss AS (SELECT from_addr, min(timestamp_ms) AS session_start_ms, max(timestamp_ms) + 1800000 AS session_end_ms,
         count(*) AS n FROM g GROUP BY from_addr, sid)
SELECT * FROM ss WHERE session_end_ms < (SELECT max(timestamp_ms) - 3600000 FROM tx)""")
def q_stream_sender_sessions(spark, sf_dir):
    """Per-sender sessions (30 min gap) in append mode: a session is final
    once the watermark (max event time - 1 h) passes its end; later ones are
    still open in state."""
    stream = tx_from_events(event_stream(spark, sf_dir))
    out = J.run_available_now(spark, J.sender_sessions(stream), "sessions")
    cutoff = tx_view(spark, sf_dir).agg(F.max(S.SORT_KEY)).first()[0] - 3_600_000
    return spark.read.parquet(out).where(F.col("session_end_ms") < F.lit(cutoff))


_REPLAY = "tx_id % 10 = 3"  # rows that the capture delivers twice
_MID = _VAL_START


@register("stream_dedup_late", f"""WITH tx AS ({TX_SQL}),
late AS (SELECT count(*) AS n_late FROM tx
         WHERE timestamp_ms < (SELECT max(timestamp_ms) FROM tx WHERE timestamp_ms < {_MID}) - 600000)
SELECT tx_id, timestamp_ms, n_late FROM tx, late""")
def q_stream_dedup_late(spark, sf_dir):
    """A capture in three deliveries: the rows before the val start, the rest with one row in
    ten twice, then the whole capture again.  Each transaction comes out once; rows of the third
    delivery behind the watermark are counted as late (Spark tests against the watermark of the batch
    before, so that of the first delivery), the remainder are replays."""
    import os
    import uuid
    from txrisk.session import checkpoint_dir
    path = os.path.join(checkpoint_dir(spark), "replay", uuid.uuid4().hex)
    tx = tx_view(spark, sf_dir).select("tx_id", S.SORT_KEY)
    rest = tx.where(F.col(S.SORT_KEY) >= _MID)
    for part in (tx.where(F.col(S.SORT_KEY) < _MID), rest.unionByName(rest.where(_REPLAY)), tx):
        part.repartition(4).write.mode("append").parquet(path)  # four files are one delivery
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 4).parquet(path)
    with J.LateRows(spark) as late:
        out = J.run_available_now(spark, J.dedup_stream(J.with_event_time(stream)).select("tx_id", S.SORT_KEY), "replay")
    return spark.read.parquet(out).withColumn("n_late", F.lit(late.dropped).cast("bigint"))
