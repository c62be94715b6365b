"""F1 threshold calibration.

The sweep runs over distinct scores (high to low) with the same ranged
prefix scan as the ranking metrics: F1 at threshold s uses every row with
score >= s, so tied scores are never split (reachable with ``>= t``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators import metrics as M


def best_f1_threshold(scored: DataFrame, by: list[str] = (), min_valid: int = 10) -> DataFrame:
    """(by…, threshold, best_f1); (0.5, 0.0) with < min_valid valid rows or no positive.

    F1 at s = 2 ctp / (cn + P); the first argmax from the top (highest score
    among equal F1) via ``max_by(score, struct(f1, score))``.
    """
    by = list(by)
    v = M.valid(scored)
    curve = M.score_curve(v, "score", "label", by)
    f1 = (2 * F.col("ctp") / (F.col("cn") + F.col("tot_pos")).cast("double"))
    best = curve.withColumn("_f1", f1).groupBy(*by).agg(
        F.max_by(F.struct("score", "_f1"), F.struct("_f1", "score")).alias("_b"),
        F.first("tot_pos").alias("_p"), (F.first("tot_pos") + F.first("tot_neg")).alias("_n"))
    ok = (F.col("_n") >= min_valid) & (F.col("_p") > 0)
    out = best.select(*by, F.when(ok, F.col("_b.score")).otherwise(F.lit(0.5)).alias("threshold"),
                      F.when(ok, F.col("_b._f1")).otherwise(F.lit(0.0)).alias("best_f1"))
    if not by:
        return out
    # groups with no valid row at all still get the fallback
    groups = scored.select(*by).distinct()
    return groups.join(F.broadcast(out), by, "left").select(
        *by, F.coalesce("threshold", F.lit(0.5)).alias("threshold"),
        F.coalesce("best_f1", F.lit(0.0)).alias("best_f1"))


def f1_at_threshold(scored: DataFrame, thresholds: DataFrame, by: list[str],
                    min_valid: int = 10) -> DataFrame:
    """M18 + P14: F1 of ``score >= threshold`` per group; 0 if tp = 0 or < min_valid rows.

    ``thresholds`` has one row per group (by…, threshold)."""
    # one row per group: broadcast
    v = M.valid(scored).join(F.broadcast(thresholds.select(*by, "threshold")), by)
    c = M.confusion(v, (F.col("score") >= F.col("threshold")).cast("int"), "label", by)
    return c.select(*by, F.when((F.col("tp") > 0) & (F.col("n_valid") >= min_valid),
                                M.f1_from_counts()).otherwise(F.lit(0.0)).alias("f1"))


def calibrate(val_scored: DataFrame, test_scored: DataFrame, by: list[str],
              min_valid: int = 10) -> DataFrame:
    """Threshold from val, F1 on test, with val F1 and the val score range."""
    t = best_f1_threshold(val_scored, by, min_valid)
    rng = val_scored.groupBy(*by).agg(F.min("score").alias("val_score_min"),
                                      F.max("score").alias("val_score_max"))
    test_f1 = f1_at_threshold(test_scored, t, by, min_valid)
    return t.join(F.broadcast(test_f1), by, "left").join(F.broadcast(rng), by, "left").select(
        *by, F.col("threshold").alias("val_optimal_threshold"),
        F.col("best_f1").alias("val_f1_at_threshold"),
        F.coalesce("f1", F.lit(0.0)).alias("test_f1"), "val_score_min", "val_score_max")
