"""Binding of the generic ``events`` table to the raw transaction schema.

The test tables carry no pending-transaction capture, so a canonical ``tx``
view is derived from ``events`` with formulas that give the same rows in
Spark and DuckDB (the oracle engine).  The SQL twin below is used by
``oracle_sql()``; both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.schema import SplitRanges

# FIXED VALUES of the binding: event type -> selector, split dates, capture end.
EVENT_SELECTORS = {
    "purchase": "0x38ed1739",
    "click": "0x3593564c",
    "error": "0xdeadbeef",
    "view": "0xa9059cbb",
}
TEST_SPLITS = SplitRanges(
    ranges={"train": ("2024-01-01", "2024-01-23"), "val": ("2024-01-23", "2024-01-27"),
            "test": ("2024-01-27", "2024-01-31")},
    capture_end="2024-01-31",
    maturity_hours=24,
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-schema transactions derived from ``events`` (one row per event)."""
    return tx_from_events(read_table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a file stream (schema from the batch table)."""
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def tx_from_events(ev: DataFrame) -> DataFrame:
    """Row-local projection, so it applies to a batch table or a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    eid = F.col("event_id")
    sel = F.lit(None).cast("string")
    for et, s in reversed(list(EVENT_SELECTORS.items())):
        sel = F.when(F.col("event_type") == et, F.lit(s)).otherwise(sel)
    wei = lambda scale: F.floor(F.col("value") * F.lit(scale)).cast("bigint").cast("string")
    return (
        ev.select(
            eid.alias("tx_id"),
            # wall-clock ts as UTC, independent of the session time zone
            F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000")
             .alias("timestamp_ms"),
            wei(1e9).alias("gas_price"),
            wei(1e8).alias("gas_tip_cap"),
            wei(2e9).alias("gas_fee_cap"),
            F.concat(k.cast("string"), F.lit("000000000000000000")).alias("value"),
            (F.lit(21000) + F.lit(100) * k).cast("string").alias("gas"),
            (eid % 500).cast("string").alias("nonce"),
            (k * 32).cast("bigint").alias("data_size"),
            F.col("user_id").cast("string").alias("from_addr"),
            F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(k.cast("string")).alias("to_addr"),
            sel.alias("data_4bytes"),
            F.when(eid % 20 == 0, F.lit(None)).when(eid % 20 <= 2, F.lit(0)).otherwise(F.lit(1))
             .cast("bigint").alias("receipt_status"),
            F.when(eid % 50 == 7, F.lit(S.MEV_VICTIM_TYPE)).alias("mev_type"),
            F.when(eid % 40 == 0, F.lit(None)).when(eid % 40 == 20, F.lit(0)).otherwise(eid)
             .cast("bigint").alias("included_at_block_height"),
        )
    )


DAY_S = 86_400
# FIXED VALUES: seconds from arrival to notice, by tx_id % 97; all others tx_id % 600
NOTICE_DELAYS = {0: DAY_S, 1: DAY_S + 1, 2: DAY_S - 1, 3: 3 * DAY_S}


def inclusion_events(tx: DataFrame) -> DataFrame:
    """Inclusion notices (incl_tx_id, incl_time) of a batch table or a stream: one for each
    row that was included or has a receipt, some just before, at or after 24 h."""
    h = F.col("included_at_block_height")
    included = (h.isNotNull() & (h != 0)) | F.col("receipt_status").isNotNull()
    delay = F.col("tx_id") % 600
    for k, s in NOTICE_DELAYS.items():
        delay = F.when(F.col("tx_id") % 97 == k, F.lit(s)).otherwise(delay)
    return tx.where(included).select(F.col("tx_id").alias("incl_tx_id"),
                                     F.timestamp_millis(F.col("timestamp_ms") + delay * 1000).alias("incl_time"))


def notice_delay_sql() -> str:
    whens = " ".join(f"WHEN tx_id % 97 = {k} THEN {s}" for k, s in NOTICE_DELAYS.items())
    return f"CASE {whens} ELSE tx_id % 600 END"


def _sel_case() -> str:
    parts = " ".join(f"WHEN '{et}' THEN '{s}'" for et, s in EVENT_SELECTORS.items())
    return f"CASE event_type {parts} END"


TX_SQL = f"""
SELECT event_id AS tx_id,
       epoch_us(ts) // 1000 AS timestamp_ms,
       CAST(CAST(floor(value * 1e9) AS BIGINT) AS VARCHAR) AS gas_price,
       CAST(CAST(floor(value * 1e8) AS BIGINT) AS VARCHAR) AS gas_tip_cap,
       CAST(CAST(floor(value * 2e9) AS BIGINT) AS VARCHAR) AS gas_fee_cap,
       CAST(k AS VARCHAR) || '000000000000000000' AS value,
       CAST(21000 + 100 * k AS VARCHAR) AS gas,
       CAST(event_id % 500 AS VARCHAR) AS nonce,
       CAST(k * 32 AS BIGINT) AS data_size,
       CAST(user_id AS VARCHAR) AS from_addr,
       CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS to_addr,
       {_sel_case()} AS data_4bytes,
       CAST(CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 20 <= 2 THEN 0 ELSE 1 END AS BIGINT)
         AS receipt_status,
       CASE WHEN event_id % 50 = 7 THEN '{S.MEV_VICTIM_TYPE}' END AS mev_type,
       CAST(CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 40 = 20 THEN 0 ELSE event_id END
         AS BIGINT) AS included_at_block_height
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
"""


# Score runs used by the evaluation queries: a seeded uniform per
# (run, task, tx) blended with the task label, rounded to 4 places so tied
# scores occur.  Deterministic in any engine with md5.
BLEND_RUNS = {"blend_a": 0.5, "blend_b": 1.5}


def blend_columns(run_id: str, weight: float, digits: int = 4) -> dict:
    """Each task's score as an expression over tx_id and the labels."""
    from txrisk.functions.scalar import seeded_uniform
    cols = {}
    for task, lab in S.TASKS.items():
        u = seeded_uniform(run_id, task, F.col("tx_id"))
        pos = F.greatest(F.col(lab), F.lit(0.0)).cast("double")
        cols[f"{task}_score"] = F.round((u + F.lit(weight) * pos) / F.lit(1.0 + weight), digits)
    return cols


def blend_scores(ds: DataFrame, run_id: str, weight: float, digits: int = 4) -> DataFrame:
    cols = blend_columns(run_id, weight, digits)
    return ds.select(F.lit(run_id).alias("run_id"), "tx_id", *[v.alias(k) for k, v in cols.items()])


def blend_scores_sql(src: str, run_id: str, weight: float, digits: int = 4) -> str:
    from txrisk.plans.sqltext import uniform_sql
    parts = []
    for task, lab in S.TASKS.items():
        u = uniform_sql(f"'{run_id}'", f"'{task}'", "tx_id")
        parts.append(f"round(({u} + {weight!r}::DOUBLE * CAST(greatest({lab}, 0.0) AS DOUBLE)) "
                     f"/ {1.0 + weight!r}::DOUBLE, {digits}) AS {task}_score")
    return f"SELECT '{run_id}' AS run_id, tx_id, {', '.join(parts)} FROM {src}"
