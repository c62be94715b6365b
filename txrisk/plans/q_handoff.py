"""Registered queries: hand-offs between jobs (raw files, rolled state, stored scores,
models' inputs, calibration and curves), each written, read back and used."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import ablate, epoch_ms
from txrisk.operators import metrics as M
from txrisk.operators import sampling as T
from txrisk.operators.baselines import RuleThresholds, rule_scores
from txrisk.operators.calibrate import calibrate
from txrisk.plans.build import round_doubles
from txrisk.plans.incremental import SnapshotStore, append_increment, build_increment
from txrisk.plans.q_build import _OTHER, DS_COLS, dataset
from txrisk.plans.q_metrics import BLEND_RUNS, RULES, rule_thresholds, score_table, scored_runs, scored_runs_sql
from txrisk.plans.q_slices import _cal_sql
from txrisk.plans.registry import register
from txrisk.plans.sqltext import FEATURE_DOUBLES, dataset_sql
from txrisk.session import checkpoint_dir
from txrisk.sources import sinks
from txrisk.sources.raw import read_raw
from txrisk.sources.testbind import TEST_SPLITS, TX_SQL, read_table, tx_view


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "handoff", f"{name}-{uuid.uuid4().hex}")


_CUTS = [epoch_ms(d) for d in ("2024-01-23", "2024-01-27", "2024-01-29", "2024-01-31")]


@register("rolled_increments", f"WITH {dataset_sql()} "
          f"SELECT {', '.join([f'round({c}, 6) AS {c}' for c in FEATURE_DOUBLES] + _OTHER)} "
          f"FROM ds WHERE timestamp_ms >= {_CUTS[0]}")
def q_rolled_increments(spark, sf_dir):
    """A1 + J1 + U1: val and test built in three increments on one rolled sender state;
    after the first, only rows from the last published state on are read."""
    tx, store = tx_view(spark, sf_dir), SnapshotStore(spark, _folder(spark, "state"))
    parts = []
    for start, end in zip(_CUTS[:-1], _CUTS[1:]):
        done = store.latest()
        new = tx if done is None else tx.where(F.col(S.SORT_KEY) >= done.upto_ms)
        parts.append(build_increment(new, start, end, TEST_SPLITS, store=store))
    return round_doubles(reduce(append_increment, parts).select(*DS_COLS))


_RAW = ["tx_id", *S.RAW_COLUMNS]
_NULLABLE = ("receipt_status", "included_at_block_height")  # whole numbers with NULLs: compared as text


@register("raw_scan", f"""WITH tx AS ({TX_SQL})
SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' if c in _NULLABLE else c for c in _RAW)} FROM tx WHERE timestamp_ms >= {_CUTS[0]} AND timestamp_ms < {_CUTS[1]}""")
def q_raw_scan(spark, sf_dir):
    """S1 + P1 + P2: raw files read with the explicit schema, pruned to the needed columns
    and to a time range that is pushed to the files."""
    path = _folder(spark, "raw")
    tx_view(spark, sf_dir).withColumn("block_number", F.lit(0)).sort(S.SORT_KEY).write.parquet(path)
    return read_raw(spark, path, _CUTS[0], _CUTS[1]).withColumns({c: F.col(c).cast("string") for c in _NULLABLE})


@register("smoke_build", f"""WITH tx_all AS ({TX_SQL}),
{dataset_sql().replace(f"tx AS ({TX_SQL})", "tx AS (SELECT * FROM tx_all ORDER BY timestamp_ms, tx_id LIMIT 5000)", 1).lstrip()}
SELECT {', '.join([f'round({c}, 6) AS {c}' for c in FEATURE_DOUBLES] + _OTHER)} FROM ds""")
def q_smoke_build(spark, sf_dir):
    """The build over the first 5 000 raw rows in time order (a smoke build is that cut)."""
    from txrisk.plans.build import build_dataset
    return round_doubles(build_dataset(T.first_n(tx_view(spark, sf_dir), 5000), TEST_SPLITS))


@register("half_split", f"""WITH {dataset_sql()},
t AS (SELECT tx_id, row_number() OVER (ORDER BY timestamp_ms, tx_id) - 1 AS i, count(*) OVER () AS n
      FROM ds WHERE split = 'train')
SELECT tx_id, CASE WHEN i < n // 2 THEN 'fit' ELSE 'eval' END AS part FROM t""")
def q_half_split(spark, sf_dir):
    """T5: train cut in two halves by time."""
    fit, rest = T.half_split(dataset(spark, sf_dir).where(F.col("split") == "train").select("tx_id", S.SORT_KEY))
    part = lambda d, name: d.select("tx_id", F.lit(name).alias("part"))
    return part(fit, "fit").unionByName(part(rest, "eval"))


@register("cached_scores", scored_runs_sql("val") + """
SELECT run_id, tx_id, revert_score, mev_score, drop_score FROM runs WHERE run_id IN ('rules', 'blend_a')""")
def q_cached_scores(spark, sf_dir):
    """S7 + S10 + S12: val scores of two runs, the rule run computed from thresholds that were saved as
    JSON and read back, each stored on first use and read on the second."""
    from txrisk.plans.evaluate import scores_or_compute
    path, val = _folder(spark, "scores"), dataset(spark, sf_dir).where(F.col("split") == "val")
    file = _folder(spark, "thresholds")
    rule_thresholds(spark, sf_dir).save(spark, file)

    def rules():
        return rule_scores(val, RuleThresholds.load(spark, file))

    def blend():
        return sinks.read_scores(spark, score_table(spark, sf_dir), "blend_a", "val").drop("run_id", "split")
    cols = ["run_id", "tx_id", *[F.col(f"{t}_score").cast("double").alias(f"{t}_score") for t in S.TASKS]]
    out = []
    for run, compute in ((RULES, rules), ("blend_a", blend)):
        scores_or_compute(spark, path, run, "val", compute)

        def never():
            raise AssertionError("stored scores were computed again")
        out.append(scores_or_compute(spark, path, run, "val", never).select(*cols))
    return out[0].unionByName(out[1])


@register("pr_curve_store", scored_runs_sql() + """
, v AS (SELECT run_id, score, label FROM long WHERE task = 'mev'),
g AS (SELECT run_id, score, count(*) AS n, sum(label) AS pos FROM v GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                sum(n) OVER (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g)
SELECT run_id, count(*) + 1 AS n_points, round(max(ctp / CAST(cn AS DOUBLE)), 6) AS best_precision,
  round(min(ctp / CAST(cn AS DOUBLE)), 6) AS base_precision FROM c GROUP BY run_id""")
def q_pr_curve_store(spark, sf_dir):
    """Precision-recall curves written by run and read back for a summary."""
    long = M.unpivot_tasks(scored_runs(spark, sf_dir), keep=["run_id", "tx_id"])
    path = _folder(spark, "pr-curve")
    sinks.write_pr_curve(M.pr_curve(M.score_curve(long.where(F.col("task") == "mev"), by=["run_id"]), by=["run_id"]), path)
    pts = spark.read.parquet(path)
    inner = F.when(F.col("threshold").isNotNull(), F.col("precision"))
    return round_doubles(pts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_points"), F.max(inner).alias("best_precision"),
                                                   F.min(inner).alias("base_precision")))


@register("calibration_store", f"""WITH cal AS ({_cal_sql()})
SELECT run_id, 'f1_calibration' AS slice, task || m.name AS metric,
  CASE m.name WHEN '_f1' THEN test_f1 WHEN '_threshold' THEN val_optimal_threshold
              WHEN '_val_f1' THEN val_f1_at_threshold END AS value,
  CASE WHEN m.name = '_threshold' THEN val_score_min END AS lower,
  CASE WHEN m.name = '_threshold' THEN val_score_max END AS upper
FROM cal, (VALUES ('_f1'), ('_threshold'), ('_val_f1')) m(name)""")
def q_calibration_store(spark, sf_dir):
    """M19 + S8: calibrated F1 written back to the metric store with its threshold, val F1
    and score range, over an earlier entry that it replaces; the latest values are read."""
    ds, path = dataset(spark, sf_dir), _folder(spark, "metrics")
    long = lambda split: M.unpivot_tasks(scored_runs(spark, sf_dir, split, ds=ds), keep=["run_id", "tx_id"]).where(
        F.col("task").isin("revert", "drop"))
    stale = long("test").select("run_id", "task").distinct().select(
        "run_id", F.lit("f1_calibration").alias("slice"), F.concat("task", F.lit("_f1")).alias("metric"), F.lit(-1.0).alias("value"))
    sinks.upsert_metrics(stale, path)
    sinks.upsert_calibration(calibrate(long("val"), long("test"), ["run_id", "task"]), path)
    return round_doubles(sinks.latest_metrics(spark, path))


_PRESETS = ("full", "no_addr", "no_identity")


def _ablation_sql() -> str:
    rows = []
    for p in _PRESETS:
        cats = S.FeatureSet.preset(p).categorical
        s = " + ".join(f"{c} / {n}.0" if c in cats else "0.0" for c, n in S.CATEGORICAL_BINS.items())
        rows.append(f"SELECT '{p}' AS run_id, tx_id, CAST(round(({s}) / 3 + least(log_gas_tip, 10.0) / 100, 4) AS DOUBLE) AS score, "
                    f"CAST(is_reverted AS DOUBLE) AS label FROM ds WHERE split = 'test' AND is_reverted >= 0")
    return f"""WITH {dataset_sql()}, v AS ({' UNION ALL '.join(rows)}),
g AS (SELECT run_id, score, CAST(count(*) AS DOUBLE) AS n, sum(label) AS pos FROM v GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp FROM g),
t AS (SELECT run_id, sum(pos) AS p, sum(n) - sum(pos) AS q FROM g GROUP BY ALL)
SELECT run_id, CAST(sum(n) AS BIGINT) AS n_valid, round(sum((n - pos) * (ctp - pos / 2.0)) / (max(p) * max(q)), 6) AS auc,
  count(*) AS n_scores FROM c JOIN t USING (run_id) GROUP BY run_id"""


@register("feature_set_ablation", _ablation_sql())
def q_feature_set_ablation(spark, sf_dir):
    """P6 + P7 + P12: one fixed scoring rule over the hashed identities, run once for each feature
    set; hashed columns outside the set are ablated to bin 0, the shape stays."""
    te = dataset(spark, sf_dir).where((F.col("split") == "test") & (F.col("is_reverted") >= 0))
    runs = []
    for p in _PRESETS:
        fs = S.FeatureSet.preset(p)
        S.check_blacklist(fs.columns)
        d = ablate(te, [c for c in S.CATEGORICAL_BINS if c not in fs.categorical])
        ident = reduce(lambda a, b: a + b, [F.col(c) / F.lit(float(n)) for c, n in S.CATEGORICAL_BINS.items()])
        runs.append(d.select(F.lit(p).alias("run_id"), "tx_id", F.col("is_reverted").alias("label"), F.round(
            ident / 3 + F.least(F.col("log_gas_tip"), F.lit(10.0)) / 100, 4).alias("score")))
    curve = M.score_curve(reduce(lambda a, b: a.unionByName(b), runs), by=["run_id"], above=0.5)
    sizes = curve.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_scores"))
    m = M.curve_metrics(curve, ["run_id"]).join(F.broadcast(sizes), "run_id")
    return round_doubles(m.select("run_id", "n_valid", "auc", "n_scores"))


@register("mergeable_auc", """WITH li AS (SELECT l_linestatus, l_discount AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem),
g AS (SELECT l_linestatus, score, count(*) AS n, sum(label) AS pos FROM li GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY l_linestatus ORDER BY score DESC ROWS UNBOUNDED PRECEDING) ctp FROM g),
t AS (SELECT l_linestatus, CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(n) - sum(pos) AS DOUBLE) AS q FROM g GROUP BY ALL)
SELECT l_linestatus, round(CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum((n - pos) * (ctp - pos / 2.0)) / (max(p) * max(q)) END, 6)
  AS value FROM c JOIN t USING (l_linestatus) GROUP BY l_linestatus""")
def q_mergeable_auc(spark, sf_dir):
    """§2.12: a Python metric with a mergeable state over all lineitems."""
    li = read_table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_discount").alias("score"),
                                                      (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return round_doubles(M.mergeable_metric(li, ["l_linestatus"], M.AUC))
