"""Structured Streaming versions of the causal features and outcomes.

Each job reads the event stream, keeps only bounded state (per sender, per
open window, per pending transaction within the maturity horizon) and writes
to a sink under the shared checkpoint folder.  ``run_available_now`` drives a
job to completion for tests and batch-equivalence checks.
"""

from __future__ import annotations

import os
import threading
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from txrisk import schema as S
from txrisk.session import checkpoint_dir, ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(tx: DataFrame, out: str = "event_time") -> DataFrame:
    return tx.withColumn(out, F.timestamp_millis(F.col(S.SORT_KEY)))


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def run_available_now(spark: SparkSession, df: DataFrame, name: str, mode: str = "append",
                      foreach_batch=None, progress: list | None = None) -> str:
    """Process everything available, then stop.  Returns the output path;
    ``progress`` (a list) receives the per-batch progress reports."""
    out, ckpt = _paths(spark, name)
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True)
    if foreach_batch is not None:
        w = w.foreachBatch(lambda b, i: foreach_batch(b, i, out))
    else:
        w = w.format("parquet").option("path", out)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if progress is not None:
        progress.extend(q.recentProgress)
    return out


class LateRows(StreamingQueryListener):
    """Counts rows dropped for arriving behind the watermark over all batches of
    the queries run inside ``with``, however many (a query itself only remembers the
    last hundred)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dropped, self.open, self.done = spark, 0, set(), threading.Event()

    def onQueryStarted(self, event) -> None:
        self.open.add(event.id)

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.open.discard(event.id)
        if not self.open:
            self.done.set()

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *exc) -> None:
        self.done.wait(60)  # events of a query come in order, its end last
        self.spark.streams.removeListener(self)


def late_rows_dropped(progress: list) -> int:
    """Rows dropped by stateful operators for arriving behind the watermark,
    over the batches in ``progress``."""
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for p in progress for op in (p.get("stateOperators") or []))


# ---------------------------------------------------------------------------
# Per-sender running state, seeded from a snapshot
# ---------------------------------------------------------------------------
class SenderState(StatefulProcessor):
    """State per sender: (count, sum of log1p(gas/1e9)).  Rows of a
    micro-batch are sorted by (ts, tx_id) and processed with vectorised
    cumulative sums; output is W2 / W3 for each row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sender", "cnt long, gas_sum double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r["_pre_count"]), float(r["_pre_gas_sum"])))

    def handleInputRows(self, key, rows, timerValues):
        cnt, gsum = self.state.get() if self.state.exists() else (0, 0.0)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([S.SORT_KEY, "tx_id"])
        g = pdf["log_gas_gwei"].fillna(0.0).to_numpy()
        c_prev = cnt + pd.RangeIndex(len(pdf)).to_numpy()
        s_prev = gsum + (g.cumsum() - g)
        avg = np.where(c_prev > 0, s_prev / np.maximum(c_prev, 1), 0.0)
        self.state.update((int(cnt + len(pdf)), float(gsum + g.sum())))
        yield pd.DataFrame({"tx_id": pdf["tx_id"].to_numpy(),
                            "sender_tx_count": (c_prev + 1).astype("float32"),
                            "sender_avg_gas": avg})

    def close(self) -> None:
        pass


def sender_state_stream(tx_stream: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(tx_id, sender_tx_count, sender_avg_gas) per arriving row.
    NULL senders carry no state (count 0, mean 0) and bypass the keyed operator."""
    spark = tx_stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_package(spark)  # the processor class is imported by the workers
    s = tx_stream.select("tx_id", S.SORT_KEY, "from_addr",
                         F.log1p(F.col("gas_price").cast("double") / 1e9).alias("log_gas_gwei"))
    keyed = s.where(F.col("from_addr").isNotNull()).groupBy("from_addr")
    init = None
    if snapshot is not None:
        init = snapshot.select("from_addr", "_pre_count", "_pre_gas_sum").groupBy("from_addr")
    out = keyed.transformWithStateInPandas(
        statefulProcessor=SenderState(),
        outputStructType="tx_id long, sender_tx_count float, sender_avg_gas double",
        outputMode="append", timeMode="None", initialState=init)
    nulls = s.where(F.col("from_addr").isNull()).select(
        "tx_id", F.lit(0.0).cast("float").alias("sender_tx_count"), F.lit(0.0).alias("sender_avg_gas"))
    return out.unionByName(nulls)


STATE = "from_addr string, _pre_count long, _pre_gas_sum double"
COMPACT = 16  # batches between two whole tables of the state


def sender_state(spark: SparkSession, out: str, batch_id: int, snapshot: DataFrame | None = None) -> DataFrame:
    """State of every sender before a batch: the last whole table (the snapshot
    at first) and what the batches since then added."""
    whole = batch_id // COMPACT * COMPACT - 1
    parts = [snapshot.select("from_addr", "_pre_count", "_pre_gas_sum")] if whole < 0 and snapshot is not None else []
    paths = [f"{out}/whole/batch={whole}"] if whole >= 0 else []
    paths += [f"{out}/added/batch={i}" for i in range(whole + 1, batch_id)]
    if paths:
        parts.append(spark.read.schema(STATE).parquet(*paths))
    if not parts:
        return spark.createDataFrame([], STATE)
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("from_addr").agg(F.sum("_pre_count").alias("_pre_count"),
                                          F.sum("_pre_gas_sum").alias("_pre_gas_sum"))


def sender_state_batches(snapshot: DataFrame | None = None, rows_per_range: int | None = None):
    """R1 as a foreachBatch writer: the same rows as ``sender_state_stream``, with
    no Python and no task that holds a sender's rows.  A batch runs through the
    ranged scans of the batch build, so a sender with most of its rows is spread
    over time ranges; what it adds per sender is combined where rows are read.
    Each folder belongs to one batch and is overwritten if the batch is retried.
    """
    from txrisk.operators.features import past_gas, plan_time_ranges, with_sender_features

    def write(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        arrived = batch.select("tx_id", S.SORT_KEY, "from_addr", past_gas().alias("_g"))
        arrived.write.mode("overwrite").parquet(f"{out}/arrived/batch={batch_id}")  # the source is read once
        rows = spark.read.schema(arrived.schema).parquet(f"{out}/arrived/batch={batch_id}")
        before = sender_state(spark, out, batch_id, snapshot)
        met = rows.select("from_addr").distinct()
        done = with_sender_features(rows, plan_time_ranges(rows, rows_per_range), before.join(met, "from_addr", "left_semi"))
        done.select("tx_id", "sender_tx_count", "sender_avg_gas") \
            .write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        added = rows.where(F.col("from_addr").isNotNull()).groupBy("from_addr").agg(
            F.count(F.lit(1)).alias("_pre_count"), F.sum("_g").alias("_pre_gas_sum"))
        added.write.mode("overwrite").parquet(f"{out}/added/batch={batch_id}")
        if batch_id % COMPACT == COMPACT - 1:
            now = before.unionByName(spark.read.schema(STATE).parquet(f"{out}/added/batch={batch_id}"))
            now.groupBy("from_addr").agg(F.sum("_pre_count").alias("_pre_count"), F.sum("_pre_gas_sum").alias("_pre_gas_sum")) \
               .write.mode("overwrite").parquet(f"{out}/whole/batch={batch_id}")
    return write


def sender_rows(spark: SparkSession, out: str) -> DataFrame:
    """(tx_id, sender_tx_count, sender_avg_gas) that ``sender_state_batches`` wrote."""
    return spark.read.schema("tx_id long, sender_tx_count float, sender_avg_gas double, batch long") \
        .parquet(f"{out}/rows").drop("batch")


# ---------------------------------------------------------------------------
# R2: arrival counts in sliding event-time windows
# ---------------------------------------------------------------------------
def arrival_windows(tx_stream: DataFrame, window: str = "60 seconds", slide: str = "5 seconds",
                    watermark: str = "10 minutes") -> DataFrame:
    """R2: rows per sliding window; state is dropped once the watermark passes
    a window's end (the exact per-row W4 count stays a batch operator)."""
    e = with_event_time(tx_stream)
    return (e.withWatermark("event_time", watermark)
             .groupBy(F.window("event_time", window, slide).alias("w"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"),
                     F.unix_millis(F.col("w.end")).alias("window_end_ms"), "n"))


def upsert_batches(batch: DataFrame, batch_id: int, out: str) -> None:
    """foreachBatch sink for update mode: append with the batch id; readers take
    the newest row per key (see ``latest``)."""
    batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    d = spark.read.parquet(path)
    vals = [c for c in d.columns if c not in keys and c != "_batch"]
    agg = d.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


# ---------------------------------------------------------------------------
# Inclusion outcome with a maturity horizon
# ---------------------------------------------------------------------------
def outcome_stream(tx_stream: DataFrame, incl_stream: DataFrame,
                   maturity_hours: int = S.DROP_MATURITY_HOURS, watermark: str = "1 hour") -> DataFrame:
    """Left outer interval join tx -> inclusion within the maturity window.
    A transaction is emitted as dropped once the watermark passes arrival +
    maturity without a notice; until then it stays in state (censored)."""
    tx = with_event_time(tx_stream).select("tx_id", "event_time").withWatermark("event_time", watermark)
    inc = incl_stream.withWatermark("incl_time", watermark)
    cond = (F.col("tx_id") == F.col("incl_tx_id")) & (F.col("incl_time") >= F.col("event_time")) & \
           (F.col("incl_time") <= F.col("event_time") + F.expr(f"INTERVAL {maturity_hours} HOURS"))
    j = tx.join(inc, cond, "leftOuter")
    return j.select("tx_id", F.unix_millis("event_time").alias(S.SORT_KEY),
                    F.col("incl_tx_id").isNull().cast("float").alias("is_dropped_stream"))


# ---------------------------------------------------------------------------
# R4 + R5: triage on arrival
# ---------------------------------------------------------------------------
def dedup_stream(tx_events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Exact replays (same tx_id and event time) are removed; rows arriving
    behind the watermark are dropped and counted (``late_rows_dropped``).
    With the event time in the key, dedup state expires with the watermark."""
    return tx_events.withWatermark("event_time", watermark).dropDuplicates(["tx_id", "event_time"])


def triage_stream(tx_stream: DataFrame, thresholds, watermark: str = "10 minutes") -> DataFrame:
    """R5 duplicates removed within the watermark, then R4 stateless features
    (F1-F5) and rule scores (F11) per arriving row."""
    from txrisk.operators.baselines import rule_scores
    from txrisk.operators.features import scalar_features
    d = dedup_stream(with_event_time(tx_stream), watermark)
    f = scalar_features(d)
    return rule_scores(f, thresholds, keep=["tx_id", S.SORT_KEY, "is_dex_candidate"])


def top_k_per_batch(k: int = 100):
    """foreachBatch writer: the k highest MEV scores of each micro-batch (ties by
    tx_id), in a folder of the batch's own that a retried batch overwrites."""
    def write(batch: DataFrame, batch_id: int, out: str) -> None:
        top = batch.orderBy(F.col("mev_score").desc(), F.col("tx_id")).limit(k)
        top.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return write


def merged_top_k(spark: SparkSession, out: str, k: int = 100) -> DataFrame:
    """The k highest over all batches that ``top_k_per_batch`` wrote."""
    return spark.read.parquet(out).orderBy(F.col("mev_score").desc(), F.col("tx_id")).limit(k)


# ---------------------------------------------------------------------------
# Per-sender bursts as session windows
# ---------------------------------------------------------------------------
def sender_sessions(tx_stream: DataFrame, gap: str = "30 minutes",
                    watermark: str = "1 hour") -> DataFrame:
    """A sender's session closes after ``gap`` without a transaction;
    one row per (sender, session) with its row count."""
    # a burst is merged where it arrives, before the shuffle by sender
    tx_stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    e = with_event_time(tx_stream).where(F.col("from_addr").isNotNull())
    return (e.withWatermark("event_time", watermark)
             .groupBy("from_addr", F.session_window("event_time", gap).alias("s"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select("from_addr", F.unix_millis(F.col("s.start")).alias("session_start_ms"),
                     F.unix_millis(F.col("s.end")).alias("session_end_ms"), "n"))
