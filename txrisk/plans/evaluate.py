"""Evaluation (survey §3.3) as Spark jobs over keyed tables.

align scores with labels -> unpivot tasks -> metric bundle, bootstrap CIs,
DEX subset, traffic strata, PR curve -> long metric table (append-only store).
Also the Δt corruption audit (M21) and the score / model hand-offs (S6-S12).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.operators import metrics as M
from txrisk.operators import sequences as Q
from txrisk.operators import slices as SL
from txrisk.operators.bootstrap import metric_bundle_ci
from txrisk.sources import sinks


def align(scores: DataFrame, processed: DataFrame, split: str,
          extra: list[str] = ("mempool_pressure", "is_dex_candidate", "row_idx")) -> DataFrame:
    """J2 + P10: inner join on tx_id (rows a model did not score drop out)."""
    part = processed.where(F.col("split") == split).select("tx_id", *S.LABEL_COLUMNS, *extra)
    return scores.join(part, "tx_id")


def evaluate(scores: DataFrame, processed: DataFrame, split: str = "test", reps: int = 1000,
             seed: int = 42) -> dict[str, DataFrame]:
    """All evaluation tables for the runs in ``scores`` (run_id, tx_id, *_score)."""
    scored = align(scores, processed, split)
    keep = ["run_id", "tx_id", "mempool_pressure", "is_dex_candidate", "row_idx"]
    long = M.unpivot_tasks(scored, keep=keep)
    mev = long.where(F.col("task") == "mev")
    point = M.metric_bundle(long, by=["run_id"]).withColumn("slice", F.lit("all"))
    out = {
        "metrics": point,
        "metrics_ci": metric_bundle_ci(long, reps, seed, by=["run_id"]) if reps else None,
        "dex_subset": SL.dex_subset_table(mev, ["run_id"]),
        "traffic": SL.traffic_quartile_metric(mev, ["run_id"]),
        "pr_curve": M.pr_curve(M.score_curve(M.valid(mev), "score", "label", ["run_id"]), "score",
                               ["run_id"]),
        "dex_per_day": SL.dex_per_day(mev, processed.where(F.col("split") == split).select("row_idx"), ["run_id"]),
    }
    return {k: v for k, v in out.items() if v is not None}


def run_evaluation(spark: SparkSession, scores: DataFrame, processed: DataFrame, root: str,
                   split: str = "test", reps: int = 1000, seed: int = 42) -> None:
    """The evaluation job end to end (survey §3.3): every table of ``evaluate``
    written under ``root`` (metrics also appended to the long store, S8)."""
    tables = evaluate(scores, processed, split, reps, seed)
    sinks.upsert_metrics(tables["metrics"], os.path.join(root, "metrics"))
    if "metrics_ci" in tables:
        ci = tables["metrics_ci"].withColumn("slice", F.lit("all")) \
            .withColumnRenamed("point", "value").drop("task")
        sinks.upsert_metrics(ci, os.path.join(root, "metrics_ci"))
    sinks.write_pr_curve(tables["pr_curve"], os.path.join(root, "pr_curve"))
    for name in ("dex_subset", "traffic", "dex_per_day"):
        tables[name].write.mode("overwrite").parquet(os.path.join(root, name))


def store_scores_and_metrics(spark: SparkSession, scores: DataFrame, processed: DataFrame,
                             root: str, split: str = "test") -> DataFrame:
    """S6 -> S7 -> M8 -> S8 -> S9: write keyed scores, read them back (all runs
    in one job, pruned to the split's partitions), append the metrics of every
    run and the PR curves, return the latest metric values."""
    score_path, metric_path = os.path.join(root, "scores"), os.path.join(root, "metrics")
    sinks.write_scores(scores.withColumn("split", F.lit(split)), score_path, mode="overwrite")
    s = spark.read.parquet(score_path).where(F.col("split") == split).drop("split")
    long = M.unpivot_tasks(align(s, processed, split, extra=[]), keep=["run_id", "tx_id"])
    sinks.upsert_metrics(M.metric_bundle(long, by=["run_id"]), metric_path)
    mev = M.valid(long.where(F.col("task") == "mev"))
    sinks.write_pr_curve(M.pr_curve(M.score_curve(mev, "score", "label", ["run_id"]), "score", ["run_id"]),
                         os.path.join(root, "pr_curve"))
    return sinks.latest_metrics(spark, metric_path)


def scores_or_compute(spark: SparkSession, path: str, run_id: str, split: str, compute) -> DataFrame:
    """Reuse stored scores of (run, split) when present, else compute and store them."""
    try:
        return sinks.read_scores(spark, path, run_id, split)
    except FileNotFoundError:
        pass  # no such run
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    s = compute().withColumn("run_id", F.lit(run_id)).withColumn("split", F.lit(split))
    sinks.write_scores(s, path, mode="append")
    return sinks.read_scores(spark, path, run_id, split)


def save_models(models: dict, path: str) -> None:
    """One MLlib PipelineModel per task."""
    for task, m in models.items():
        m.write().overwrite().save(os.path.join(path, task))


def load_models(path: str) -> dict:
    from pyspark.ml import PipelineModel
    return {t: PipelineModel.load(os.path.join(path, t)) for t in S.TASKS}


def corruption_audit(models: dict, processed: DataFrame, split: str = "test", seq_len: int = 1024,
                     warmup: int = 64, seed: int = 42) -> DataFrame:
    """Rescore all rows of the split (the last window may be short) with Δt
    shuffled inside 1024-row windows (W7) or snapped to train-bin medians (A7 + F14) and compare the metric bundle
    per mode.  ``models`` score a Δt-using feature set (e.g. the MLlib baselines)."""
    from txrisk.operators.baselines import score_models
    part = processed.where(F.col("split") == split)
    i0 = part.agg(F.min("row_idx")).first()[0] or 0
    rows = Q.window_rows(part.withColumn("_i", F.col("row_idx") - F.lit(i0)), seq_len, warmup, keep_tail=True)
    shuffled = Q.shuffle_within_window(rows, seed=seed).withColumn(
        "timestamp_delta_s", F.col("timestamp_delta_s_shuffled"))
    b = Q.delta_bins(processed.where(F.col("split") == "train"))  # 3 edges, 4 medians
    quant = Q.quantize_delta(rows, list(b["edges"]), list(b["medians"])).withColumn(
        "timestamp_delta_s", F.col("timestamp_delta_s_quantized"))
    out = None
    for mode, d in {"none": rows, "shuffle": shuffled, "quantize": quant}.items():
        s = score_models(models, d.select("tx_id", *S.FEATURE_COLUMNS, *S.LABEL_COLUMNS),
                         ["tx_id", *S.LABEL_COLUMNS]).withColumn("run_id", F.lit(mode))
        m = M.metric_bundle(M.unpivot_tasks(s, keep=["run_id", "tx_id"]), by=["run_id"])
        out = m if out is None else out.unionByName(m)
    return out.withColumnRenamed("run_id", "mode")
