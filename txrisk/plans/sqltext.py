"""SQL text shared by the oracle queries (DuckDB dialect, ANSI where possible)."""

from __future__ import annotations

from txrisk import schema as S
from txrisk.functions.scalar import epoch_ms
from txrisk.sources.testbind import TEST_SPLITS, TX_SQL


def hash_bin_sql(col: str, n_bins: int) -> str:
    return (f"CASE WHEN {col} IS NULL THEN 0 ELSE "
            f"CAST(('0x' || substr(md5({col}), 1, 15)) AS BIGINT) % {n_bins - 1} + 1 END")


def uniform_sql(*parts: str) -> str:
    """SQL twin of functions.seeded_uniform (parts are SQL expressions)."""
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def split_case_sql(ts: str = "timestamp_ms", splits=TEST_SPLITS) -> str:
    parts = " ".join(
        f"WHEN {ts} >= {epoch_ms(a)} AND {ts} < {epoch_ms(b)} THEN '{n}'"
        for n, (a, b) in splits.ranges.items())
    return f"CASE {parts} END"


def dex_sql(col: str = "data_4bytes") -> str:
    lst = ", ".join(f"'{s}'" for s in S.DEX_SELECTORS)
    return f"coalesce({col} IN ({lst}), false)"


def dataset_sql(splits=TEST_SPLITS, extra_cols: str = "") -> str:
    """CTEs ``tx``, ``feat`` and ``ds`` (features + labels + split, in ranges only)."""
    cutoff = epoch_ms(splits.capture_end) - splits.maturity_hours * 3_600_000
    o = "ORDER BY timestamp_ms, tx_id"
    ws = f"PARTITION BY from_addr {o}"
    lg = "ln(1 + CAST(gas_price AS DOUBLE) / 1e9)"
    return f"""
tx AS ({TX_SQL}),
feat AS (
  SELECT tx_id, timestamp_ms,
    (row_number() OVER ({o}) - 1) AS row_idx,
    ln(1 + CAST(gas_price AS DOUBLE) / 1e9) AS log_gas_price,
    ln(1 + CAST(gas_tip_cap AS DOUBLE) / 1e9) AS log_gas_tip,
    ln(1 + CAST(gas_fee_cap AS DOUBLE) / 1e9) AS log_gas_fee,
    ln(1 + CAST(value AS DOUBLE) / 1e18) AS log_value,
    ln(1 + CAST(gas AS DOUBLE)) AS log_gas,
    ln(1 + CAST(nonce AS DOUBLE)) AS log_nonce,
    ln(1 + CAST(data_size AS DOUBLE)) AS log_data_size,
    least(greatest(CAST(timestamp_ms - coalesce(lag(timestamp_ms) OVER ({o}), timestamp_ms) AS DOUBLE)
          / 1000.0::DOUBLE, 0.0::DOUBLE), 300.0::DOUBLE) AS timestamp_delta_s,
    CAST(count(from_addr) OVER ({ws} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS FLOAT)
      AS sender_tx_count,
    coalesce(sum({lg}) OVER ({ws} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      / nullif(count(from_addr) OVER ({ws} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
      0.0::DOUBLE) AS sender_avg_gas,
    CAST(count(*) OVER (ORDER BY timestamp_ms RANGE BETWEEN 60000 PRECEDING AND 1 PRECEDING)
      + row_number() OVER (PARTITION BY timestamp_ms ORDER BY tx_id) - 1 AS FLOAT) AS mempool_pressure,
    {hash_bin_sql('from_addr', S.CATEGORICAL_BINS['from_addr_hash'])} AS from_addr_hash,
    {hash_bin_sql('to_addr', S.CATEGORICAL_BINS['to_addr_hash'])} AS to_addr_hash,
    {hash_bin_sql('data_4bytes', S.CATEGORICAL_BINS['data_4bytes_hash'])} AS data_4bytes_hash,
    {dex_sql()} AS is_dex_candidate,
    CAST(CASE WHEN receipt_status IS NULL THEN -1 WHEN receipt_status = 0 THEN 1 ELSE 0 END AS FLOAT)
      AS is_reverted,
    CAST(CASE WHEN mev_type = '{S.MEV_VICTIM_TYPE}' THEN 1 ELSE 0 END AS FLOAT) AS is_mev_victim,
    CAST(CASE WHEN timestamp_ms > {cutoff} THEN -1
              WHEN (included_at_block_height = 0 OR included_at_block_height IS NULL)
                   AND receipt_status IS NULL THEN 1 ELSE 0 END AS FLOAT) AS is_dropped,
    {split_case_sql(splits=splits)} AS split
    {extra_cols}
  FROM tx
),
ds AS (SELECT * FROM feat WHERE split IS NOT NULL)
"""


def round_select(cols_double: list[str], cols_other: list[str], src: str) -> str:
    sel = [f"round({c}, 6) AS {c}" for c in cols_double] + list(cols_other)
    return f"SELECT {', '.join(sel)} FROM {src}"


FEATURE_DOUBLES = [c for c in S.NUMERIC_FEATURES if c not in ("sender_tx_count", "mempool_pressure")]
