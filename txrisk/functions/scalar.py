"""Column expressions (F1-F18, P3, P8, P13, P14 and the seeded randomness of §4.2).

All of these are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S

__all__ = [
    "cast_string_numerics", "log_features", "clip", "hash_bin", "categorical_hashes",
    "is_dex", "label_is_reverted", "label_is_mev_victim", "label_is_dropped", "epoch_ms",
    "digitize", "quantize", "sigmoid", "softplus", "softplus_delta", "calibrate_b",
    "feature_fingerprint", "bce_with_logits", "focal_loss", "seeded_uniform", "poisson1",
    "predict_gt", "predict_ge", "logit", "ablate", "poisson1_sql", "POISSON1_CDF",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P3 -------------------------------------------------------------------------
def cast_string_numerics(df: DataFrame, cols=S.RAW_STRING_NUMERIC_COLS, strict: bool = True) -> DataFrame:
    """Cast the big-integer text columns to double.  ``strict`` raises on bad text (ANSI)."""
    present = [c for c in cols if c in df.columns]
    if strict:
        return df.withColumns({c: F.col(c).cast("double") for c in present})
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in present})


# F1-F3 ----------------------------------------------------------------------
def log_features(df: DataFrame) -> DataFrame:
    """log1p of the heavy-tailed numerics; wei scaled to gwei (1e9) or eth (1e18)."""
    d = lambda c: F.col(c).cast("double")
    return df.withColumns({
        "log_gas_price": F.log1p(d("gas_price") / 1e9),
        "log_gas_tip": F.log1p(d("gas_tip_cap") / 1e9),
        "log_gas_fee": F.log1p(d("gas_fee_cap") / 1e9),
        "log_value": F.log1p(d("value") / 1e18),
        "log_gas": F.log1p(d("gas")),
        "log_nonce": F.log1p(d("nonce")),
        "log_data_size": F.log1p(d("data_size")),
    })


# F4 -------------------------------------------------------------------------
def clip(x, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


# F5 -------------------------------------------------------------------------
def hash_bin(x, n_bins: int, fn: str = "md5") -> Column:
    """NULL -> 0, else hash mod (n_bins-1) + 1 (never 0).

    ``md5`` is portable (first 15 hex digits, same bins in any engine);
    ``xxhash64`` is Spark's native 64-bit hash.
    """
    x = _c(x)
    if fn == "md5":
        h = F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("bigint")
    elif fn == "xxhash64":
        h = F.xxhash64(x)
    else:
        raise ValueError(f"unknown hash fn {fn!r}")
    return F.when(x.isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(h, F.lit(n_bins - 1)) + 1)


def categorical_hashes(df: DataFrame, fn: str = "md5") -> DataFrame:
    return df.withColumns({
        out: hash_bin(S.CATEGORICAL_SOURCES[out], n, fn) for out, n in S.CATEGORICAL_BINS.items()
    })


# P8 -------------------------------------------------------------------------
def is_dex(selector="data_4bytes", selectors=S.DEX_SELECTORS) -> Column:
    """Membership in the DEX selector list; NULL -> false."""
    return F.coalesce(_c(selector).isin(list(selectors)), F.lit(False))


# F6-F9 ----------------------------------------------------------------------
def label_is_reverted(receipt="receipt_status") -> Column:
    r = _c(receipt)
    return (F.when(r.isNull(), -1).when(r.cast("bigint") == 0, 1).otherwise(0)).cast("float")


def label_is_mev_victim(mev_type="mev_type") -> Column:
    return F.when(_c(mev_type) == S.MEV_VICTIM_TYPE, 1).otherwise(0).cast("float")


def label_is_dropped(ts="timestamp_ms", height="included_at_block_height",
                     receipt="receipt_status", cutoff_ms: int | None = None) -> Column:
    h = _c(height).cast("bigint")
    raw = ((h == 0) | h.isNull()) & _c(receipt).isNull()
    lab = F.when(raw, 1).otherwise(0)
    if cutoff_ms is not None:
        lab = F.when(_c(ts) > F.lit(cutoff_ms), -1).otherwise(lab)
    return lab.cast("float")


# F10 ------------------------------------------------------------------------
def epoch_ms(date_str: str) -> int:
    """'YYYY-MM-DD[ HH:MM:SS]' (UTC) -> epoch milliseconds, computed on the driver."""
    from datetime import datetime, timezone
    fmt = "%Y-%m-%d %H:%M:%S" if " " in date_str else "%Y-%m-%d"
    dt = datetime.strptime(date_str, fmt).replace(tzinfo=timezone.utc)
    return int(dt.timestamp() * 1000)


# F15 / F14 ------------------------------------------------------------------
def digitize(x, edges) -> Column:
    """np.digitize with increasing edges: number of edges <= x (left-closed bins)."""
    x = _c(x)
    acc = F.lit(0)
    for e in edges:
        acc = acc + (x >= F.lit(float(e))).cast("int")
    return acc


def quantize(x, edges, medians, closed: str = "right") -> Column:
    """Snap x to its bin's median.  ``right``: bin i holds (e_{i-1}, e_i] (bucketize);
    ``left``: [e_{i-1}, e_i) (digitize)."""
    x = _c(x).cast("float")  # values and edges meet at float32
    out = F.lit(float(medians[-1]))
    for e, m in reversed(list(zip(edges, medians[:-1]))):
        edge = F.lit(float(e)).cast("float")
        cond = (x <= edge) if closed == "right" else (x < edge)
        out = F.when(cond, F.lit(float(m))).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


# F16, F12, F13 --------------------------------------------------------------
def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def logit(p, eps: float = 1e-7) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def softplus(z) -> Column:
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def softplus_delta(delta_s, a: float = 1.0, b: float = 0.0,
                   lo: float = S.DELTA_CLIP_MIN, hi: float = S.DELTA_CLIP_MAX) -> Column:
    return softplus(F.lit(a) * F.log1p(clip(delta_s, lo, hi)) + F.lit(b))


def softplus_inverse(y: float) -> float:
    """x with softplus(x) = y, in the form that is stable for any y > 0."""
    return y + math.log(-math.expm1(-y))


def calibrate_b(median_delta, target: float | None = None, lo: float = S.DELTA_CLIP_MIN) -> Column:
    """b such that softplus(log1p(median) + b) hits the target step (default: the
    geometric mean of 1e-3 and 0.1)."""
    step = math.sqrt(0.001 * 0.1) if target is None else target
    return F.lit(softplus_inverse(step)) - F.log1p(F.greatest(_c(median_delta), F.lit(lo)))


# F17 ------------------------------------------------------------------------
def feature_fingerprint(cols) -> str:
    """md5 of the comma-joined feature names (schema-level, no data)."""
    import hashlib
    return hashlib.md5(",".join(cols).encode()).hexdigest()


# F18 ------------------------------------------------------------------------
def bce_with_logits(z, y, pos_weight: float = 1.0) -> Column:
    """Element-wise BCE from a logit; log(sigmoid) in the stable softplus form."""
    z, y = _c(z), _c(y)
    log_p = -softplus(-z)
    log_1mp = -softplus(z)
    return -(F.lit(pos_weight) * y * log_p + (1 - y) * log_1mp)


def focal_loss(z, y, gamma: float = S.FOCAL_GAMMA, alpha: float = S.FOCAL_ALPHA) -> Column:
    """-alpha (1 - q)^gamma log q, q being the probability given to the true class."""
    z = _c(z)
    hit, miss = sigmoid(z), sigmoid(-z)
    positive = F.lit(alpha) * F.pow(miss, F.lit(gamma)) * softplus(-z)
    negative = F.lit(1 - alpha) * F.pow(hit, F.lit(gamma)) * softplus(z)
    return F.when(_c(y) == 1, positive).when(_c(y) == 0, negative)


# P13 / P14 ------------------------------------------------------------------
def predict_gt(score, t: float = 0.5) -> Column:
    return (_c(score) > F.lit(t)).cast("int")


def predict_ge(score, t) -> Column:
    t = t if isinstance(t, Column) else F.lit(t)
    return (_c(score) >= t).cast("int")


# Seeded randomness (§4.2) ---------------------------------------------------
def seeded_uniform(*parts) -> Column:
    """Uniform [0,1) from md5 of '|'-joined parts: 13 hex digits / 2^52.

    Independent of partitioning and recomputation (unlike rand()), and the
    same value in any engine with md5.  Parts are Columns or Python literals.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    s = F.concat_ws("|", *cols)
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52))


# Poisson(1) cumulative probabilities P(K <= k), k = 0..15, from exp(-1)/k!.
_POISSON1_CDF = []
_acc = 0.0
for _k in range(16):
    _acc += math.exp(-1.0) / math.factorial(_k)
    _POISSON1_CDF.append(round(_acc, 15))
POISSON1_CDF = tuple(_POISSON1_CDF)


def poisson1(u) -> Column:
    """Inverse-CDF Poisson(1) draw from a uniform: number of CDF steps below u."""
    u = _c(u)
    acc = F.lit(0)
    for c in _POISSON1_CDF:
        acc = acc + (u >= F.lit(c)).cast("int")
    return acc


def poisson1_sql(u_sql: str) -> str:
    """The same draw as SQL text (for oracle queries)."""
    return "(" + " + ".join(f"CAST({u_sql} >= {c!r} AS INTEGER)" for c in _POISSON1_CDF) + ")"


# Replicate weights (T7): one hash per row, mixed with a counter per replicate.
# FIXED VALUES of the mixing, the same in Spark, numpy and SQL.
_MASK = 2 ** 32 - 1
_REP_STEP = 2654435769
_MIX = 73244475
POISSON1_CUTS = tuple(math.ceil(c * 2 ** 32) for c in POISSON1_CDF if math.ceil(c * 2 ** 32) < 2 ** 32)


def row_hash(seed, key) -> tuple[Column, Column]:
    """Two 32-bit numbers of a row, from one md5 of (seed, key)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return tuple(F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def replicate_weights(h1, h2, reps: int):
    """Poisson(1) weights, one row of ``reps`` for each pair of hashes (numpy)."""
    import numpy as np

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> np.uint64(16))) * np.uint64(_MIX)) & np.uint64(_MASK)
        return x ^ (x >> np.uint64(16))
    counter = (np.arange(reps, dtype=np.uint64) * np.uint64(_REP_STEP)) & np.uint64(_MASK)
    x = mix(np.asarray(h1, np.uint64)[:, None] ^ counter[None, :])
    x = mix(x ^ np.asarray(h2, np.uint64)[:, None])
    return np.searchsorted(np.array(POISSON1_CUTS, np.uint64), x, side="right")


def replicate_weight_array(seed, key, reps: int) -> Column:
    """The same weights as an array column."""
    h1, h2 = row_hash(seed, key)

    def mix(a):
        for _ in range(2):
            a = F.transform(a, lambda x: (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * F.lit(_MIX)).bitwiseAND(F.lit(_MASK)))
        return F.transform(a, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 16)))
    a = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint")),
                    lambda r: h1.bitwiseXOR((r * F.lit(_REP_STEP)).bitwiseAND(F.lit(_MASK))))
    a = mix(F.transform(mix(a), lambda x: x.bitwiseXOR(h2)))

    def draw(x):
        out = F.lit(0)
        for c in POISSON1_CUTS:
            out = out + (x >= F.lit(c)).cast("int")
        return out
    return F.transform(a, draw)


def replicate_weight_sql(seed, key: str, rep: str) -> str:
    """The same draw for SQL: select items ending in ``w`` (each may use the ones before it)."""
    h = f"md5('{seed}' || '|' || CAST({key} AS VARCHAR))"
    number = lambda at: f"CAST(('0x' || substr({h}, {at}, 8)) AS BIGINT)"
    step = lambda x, to: f"((xor({x}, {x} >> 16) * {_MIX}) & {_MASK}) AS {to}"
    items = [f"xor({number(1)}, ({rep} * {_REP_STEP}) & {_MASK}) AS x0", step("x0", "x1"), step("x1", "x2"),
             f"xor(xor(x2, x2 >> 16), {number(9)}) AS x3", step("x3", "x4"), step("x4", "x5"),
             "xor(x5, x5 >> 16) AS x6",
             " + ".join(f"CAST(x6 >= {c} AS INTEGER)" for c in POISSON1_CUTS) + " AS w"]
    return ", ".join(items)


# P12 ------------------------------------------------------------------------
def ablate(df, cols=tuple(S.CATEGORICAL_BINS)):
    """Identity ablation: hashed identity columns set to bin 0, shape kept."""
    return df.withColumns({c: F.lit(0).cast("bigint") for c in cols})


# Poisson(n) from a uniform ----------------------------------------------------
def _poisson_n_np(n, u):
    """Exact Poisson(n) draws, each a function of its own uniform u.  The CDF is
    stepped through where it starts above the least double (exp(-n) underflows
    beyond); else numpy's exact sampler runs, seeded by the bits of u."""
    import numpy as np
    n = np.asarray(n, dtype=float)
    u = np.asarray(u, dtype=float)
    out = np.zeros(len(n), dtype=np.int64)
    small = (n > 0) & (n <= 400)
    if small.any():
        ns, us = n[small], u[small]
        p = np.exp(-ns)
        c = p.copy()
        k = np.zeros(len(ns), dtype=np.int64)
        kmax = int(ns.max() + 10 * np.sqrt(ns.max()) + 20)
        for i in range(1, kmax + 1):  # all elements step through the CDF together
            below = c < us
            if not below.any():
                break
            k += below
            p = p * ns / i
            c = c + p
        out[small] = k
    for i in np.flatnonzero(n > 400):
        out[i] = np.random.Generator(np.random.PCG64(int(u[i] * 2.0**53))).poisson(n[i])
    return out


def _poisson_n_batch(nn: pd.Series, uu: pd.Series) -> pd.Series:
    return pd.Series(_poisson_n_np(nn.to_numpy(), uu.to_numpy()).astype("int64"))


_POISSON_N_UDF = None


def poisson_n(n, u) -> Column:
    """Exact Poisson(n) draw from a uniform u, as a long.  An Arrow-batched pandas UDF."""
    global _POISSON_N_UDF
    from pyspark.sql import SparkSession
    from txrisk.session import ship_package
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)  # workers import this module
    if _POISSON_N_UDF is None:  # needs an active session
        _POISSON_N_UDF = F.pandas_udf(_poisson_n_batch, "long")
    return _POISSON_N_UDF(_c(n).cast("double"), _c(u).cast("double"))
