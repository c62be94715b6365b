"""Loss report (A14 with F16/F18): the multi-task training objective as an
aggregate over a scored table, for comparing models on one number.

revert: BCE with pos_weight 10 over valid rows; mev: focal (gamma 2,
alpha .95) over all rows; drop: BCE over valid rows (the -1 rows are masked,
see Q8); total = 1 * revert + 2 * mev + 0.5 * drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import bce_with_logits, focal_loss, logit


def loss_report(scored: DataFrame, by: list[str] = (), eps: float = 1e-7) -> DataFrame:
    """Input: (by…, revert_score, mev_score, drop_score, is_reverted,
    is_mev_victim, is_dropped) with probabilities; logits are recovered."""
    z = {t: logit(F.col(f"{t}_score").cast("double"), eps) for t in S.TASKS}
    y = {t: F.col(lab).cast("double") for t, lab in S.TASKS.items()}
    rev = F.when(y["revert"] >= 0, bce_with_logits(z["revert"], y["revert"], S.REVERT_POS_WEIGHT))
    mev = focal_loss(z["mev"], y["mev"])
    drop = F.when(y["drop"] >= 0, bce_with_logits(z["drop"], y["drop"]))
    agg = scored.groupBy(*by).agg(F.coalesce(F.avg(rev), F.lit(0.0)).alias("revert_loss"),
                                  F.avg(mev).alias("mev_loss"),
                                  F.coalesce(F.avg(drop), F.lit(0.0)).alias("drop_loss"))
    w = S.LOSS_WEIGHTS
    return agg.withColumn("total_loss", w["revert"] * F.col("revert_loss") + w["mev"] * F.col("mev_loss")
                          + w["drop"] * F.col("drop_loss"))
