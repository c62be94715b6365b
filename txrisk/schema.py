"""Column names, bins, split ranges and other fixed values.

Everything here is a constant of the data model; operators take them as
defaults and accept overrides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
RAW_STRING_NUMERIC_COLS = ["gas_price", "gas_tip_cap", "gas_fee_cap", "value", "nonce", "gas"]
SORT_KEY = "timestamp_ms"
NUMERIC_FEATURES = [
    "log_gas_price", "log_gas_tip", "log_gas_fee", "log_value", "log_gas", "log_nonce",
    "log_data_size", "timestamp_delta_s", "sender_tx_count", "sender_avg_gas",
    "mempool_pressure",
]
CATEGORICAL_BINS = {"from_addr_hash": 131072, "to_addr_hash": 131072, "data_4bytes_hash": 16384}
CATEGORICAL_SOURCES = {"from_addr_hash": "from_addr", "to_addr_hash": "to_addr",
                       "data_4bytes_hash": "data_4bytes"}
LABEL_COLUMNS = ["is_reverted", "is_mev_victim", "is_dropped"]
BLACKLISTED_COLUMNS = [
    "receipt_status", "receipt_gas_used", "inclusion_delay_ms", "included_block_timestamp_ms",
    "included_at_block_height", "block_number", "mev_type", "sources",
]
SPLIT_RANGES = {"train": ("2026-02-01", "2026-03-25"), "val": ("2026-03-25", "2026-04-01"),
                "test": ("2026-04-01", "2026-04-08")}
CAPTURE_END_DATE = "2026-04-08"
DROP_MATURITY_HOURS = 24
DELTA_CLIP_MIN = 1e-3
DELTA_CLIP_MAX = 300.0
PRESSURE_WINDOW_MS = 60_000
LOOKBACK_MS = 5 * 60 * 1000
DEX_SELECTORS = [
    "0x38ed1739", "0x8803dbee", "0x7ff36ab5", "0x18cbafe5", "0xfb3bdb41",
    "0x5ae401dc", "0x414bf389", "0xc04b8d59", "0xdb3e2198", "0xf28c0498",
    "0x3593564c", "0x12aa3caf", "0xe449022e", "0x0502b1c5", "0xd9627aa4",
    "0x415565b0",
]
MEV_VICTIM_TYPE = "sandwich_victim"
TASKS = {"revert": "is_reverted", "mev": "is_mev_victim", "drop": "is_dropped"}
LOSS_WEIGHTS = {"revert": 1.0, "mev": 2.0, "drop": 0.5}
REVERT_POS_WEIGHT = 10.0
FOCAL_GAMMA = 2.0
FOCAL_ALPHA = 0.95
# end of fixed values
# ---------------------------------------------------------------------------

CATEGORICAL_FEATURES = list(CATEGORICAL_BINS)
FEATURE_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES

RAW_COLUMNS = [
    SORT_KEY, "gas_price", "gas_tip_cap", "gas_fee_cap", "value", "gas", "nonce", "data_size",
    "from_addr", "to_addr", "data_4bytes", "receipt_status", "mev_type",
    "included_at_block_height",
]

RAW_SCHEMA = T.StructType([
    T.StructField("tx_id", T.LongType(), False),
    T.StructField("timestamp_ms", T.LongType(), False),
    T.StructField("gas_price", T.StringType()),
    T.StructField("gas_tip_cap", T.StringType()),
    T.StructField("gas_fee_cap", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("gas", T.StringType()),
    T.StructField("nonce", T.StringType()),
    T.StructField("data_size", T.LongType()),
    T.StructField("from_addr", T.StringType()),
    T.StructField("to_addr", T.StringType()),
    T.StructField("data_4bytes", T.StringType()),
    T.StructField("receipt_status", T.LongType()),
    T.StructField("mev_type", T.StringType()),
    T.StructField("included_at_block_height", T.LongType()),
])


@dataclass(frozen=True)
class FeatureSet:
    """Model input columns (P6).  Presets mirror the ablation configs."""

    numeric: tuple = tuple(NUMERIC_FEATURES)
    categorical: tuple = tuple(CATEGORICAL_FEATURES)

    @property
    def columns(self) -> list[str]:
        return list(self.numeric) + list(self.categorical)

    @classmethod
    def preset(cls, name: str) -> "FeatureSet":
        presets = {
            "full": cls(),
            "no_addr": cls(categorical=("data_4bytes_hash",)),
            "no_identity": cls(categorical=()),
            "numeric_only": cls(categorical=()),
        }
        if name not in presets:
            raise ValueError(f"unknown feature preset {name!r}; have {sorted(presets)}")
        return presets[name]


@dataclass(frozen=True)
class SplitRanges:
    """Named half-open date ranges [start, end)."""

    ranges: dict = field(default_factory=lambda: dict(SPLIT_RANGES))
    capture_end: str = CAPTURE_END_DATE
    maturity_hours: int = DROP_MATURITY_HOURS


def check_blacklist(columns) -> None:
    """No model input may carry post-inclusion information."""
    bad = [c for c in columns if c in BLACKLISTED_COLUMNS]
    if bad:
        raise ValueError(f"blacklisted column(s) among features: {bad}")
