"""Registered queries: slices, bootstrap CIs, F1 calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions.scalar import replicate_weight_sql
from txrisk.operators import metrics as M
from txrisk.operators import slices as SL
from txrisk.operators.bootstrap import metric_bundle_ci
from txrisk.operators.calibrate import calibrate
from txrisk.plans.build import round_doubles
from txrisk.plans.q_build import HOUR_SQL, dataset, dataset_hourly
from txrisk.plans.q_metrics import bundle_sql, scored_runs, scored_runs_sql
from txrisk.plans.registry import register

EXTRA = ["hour_pressure", "is_dex_candidate", "row_idx"]
EXTRA_SQL = ", p.hour_pressure, p.is_dex_candidate, p.row_idx"
BOOT_REPS = 100  # the resample count used for the paper's intervals
SEED = 42


def _long(spark, sf_dir, split="test"):
    return M.unpivot_tasks(scored_runs(spark, sf_dir, split, ds=dataset_hourly(spark, sf_dir), extra=EXTRA),
                           keep=["run_id", "tx_id", *EXTRA])


def curve_sql(name: str, src: str, keys: str, weight: str = "1") -> str:
    """CTEs: {name}_g per-score counts, {name} cumulative, {name}_m (auc, ap) per keys."""
    part = f"PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING"
    return f"""{name}_g AS (SELECT {keys}, score, CAST(sum({weight}) AS DOUBLE) AS n,
                    CAST(sum({weight} * label) AS DOUBLE) AS pos FROM {src} GROUP BY {keys}, score),
{name} AS (SELECT *, sum(pos) OVER ({part}) AS ctp, sum(n) OVER ({part}) AS cn FROM {name}_g WHERE n > 0),
{name}_t AS (SELECT {keys}, sum(pos) AS tot_p, sum(n) - sum(pos) AS tot_q FROM {name}_g GROUP BY {keys}),
{name}_m AS (SELECT {keys},
   CASE WHEN max(tot_p) > 0 AND max(tot_q) > 0
        THEN sum((n - pos) * (ctp - pos / 2.0)) / (max(tot_p) * max(tot_q)) END AS auc,
   CASE WHEN max(tot_p) > 0 THEN sum(pos * ctp / cn) / max(tot_p) END AS ap
   FROM {name} JOIN {name}_t USING ({keys}) GROUP BY {keys})"""


# ---------------------------------------------------------------------------
@register("traffic_quartiles", scored_runs_sql(extra=EXTRA_SQL, columns=HOUR_SQL) + f""",
mv AS (SELECT * FROM long WHERE task = 'mev'),
e AS (SELECT run_id, quantile_cont(CAST(hour_pressure AS DOUBLE), [0.25, 0.5, 0.75]) AS qs
      FROM mv GROUP BY run_id),
d AS (SELECT mv.*, 1 + CAST(CAST(hour_pressure AS DOUBLE) >= qs[1] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[2] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[3] AS INTEGER) AS quartile
      FROM mv JOIN e USING (run_id)),
{curve_sql('c', 'd', 'run_id, quartile')},
t AS (SELECT run_id, quartile, count(*) AS n_rows, sum(label) AS n_pos FROM d GROUP BY ALL),
sp AS (SELECT e.*, CAST(i AS INTEGER) AS quartile FROM e, range(1, 5) r(i))
SELECT run_id, quartile, coalesce(n_rows, 0) AS n_rows,
  round(CASE WHEN coalesce(n_rows, 0) < 10 THEN NULL WHEN n_pos > 0 AND n_pos < n_rows THEN ap ELSE 0.0 END, 6)
    AS mev_pr_auc, round(qs[1], 6) AS p25, round(qs[2], 6) AS p50, round(qs[3], 6) AS p75
FROM sp LEFT JOIN t USING (run_id, quartile) LEFT JOIN c_m USING (run_id, quartile)""")
def q_traffic_quartiles(spark, sf_dir):
    """M9 + M10 + A4 + F15: MEV AP per pressure quartile of the evaluated rows."""
    mev = _long(spark, sf_dir).where(F.col("task") == "mev")
    return round_doubles(SL.traffic_quartile_metric(mev, ["run_id"], "hour_pressure"))


@register("dex_subset", scored_runs_sql(extra=EXTRA_SQL, columns=HOUR_SQL) + f""",
mv AS (SELECT * FROM long WHERE task = 'mev'),
d AS (SELECT *, 'overall' AS slice FROM mv
      UNION ALL SELECT *, CASE WHEN is_dex_candidate THEN 'dex_only' ELSE 'non_dex' END FROM mv),
{curve_sql('c', 'd', 'run_id, slice')},
top AS (SELECT run_id, slice, label,
          row_number() OVER (PARTITION BY run_id, slice ORDER BY score DESC, tx_id) AS rn FROM d),
h AS (SELECT run_id, slice, sum(CASE WHEN rn <= 100 THEN label ELSE 0 END) AS h100,
             sum(CASE WHEN rn <= 1000 THEN label ELSE 0 END) AS h1000 FROM top GROUP BY ALL),
t AS (SELECT run_id, slice, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM d GROUP BY ALL),
pk AS (SELECT run_id, slice, n, n_pos,
         CASE WHEN n_pos >= 1 AND n_pos < n THEN ap END AS mev_pr_auc,
         h100 / least(100, n) AS mev_p_at_100, h1000 / least(1000, n) AS mev_p_at_1000,
         CASE WHEN n_pos > 0 THEN h1000 / n_pos ELSE 0.0 END AS mev_recall_at_1000
       FROM t JOIN h USING (run_id, slice) LEFT JOIN c_m USING (run_id, slice)),
ov AS (SELECT run_id, mev_pr_auc AS ap_all, n_pos / n AS rate_all FROM pk WHERE slice = 'overall')
SELECT run_id, slice, n, n_pos, round(mev_pr_auc, 6) AS mev_pr_auc, round(mev_p_at_100, 6) AS mev_p_at_100,
  round(mev_p_at_1000, 6) AS mev_p_at_1000, round(mev_recall_at_1000, 6) AS mev_recall_at_1000,
  round(CASE WHEN slice = 'dex_only' AND ap_all <> 0 THEN mev_pr_auc / ap_all END, 6) AS pr_auc_lift,
  round(CASE WHEN rate_all <> 0 THEN (n_pos / n) / rate_all END, 6) AS rate_lift
FROM pk LEFT JOIN ov USING (run_id)""")
def q_dex_subset(spark, sf_dir):
    """M11 + M12 + A13 + A15 + P11: overall / DEX / non-DEX MEV pack per run, lifts."""
    mev = _long(spark, sf_dir).where(F.col("task") == "mev")
    return round_doubles(SL.dex_subset_table(mev, ["run_id"]))


@register("pressure_quintiles", scored_runs_sql(extra=EXTRA_SQL, columns=HOUR_SQL) + f""",
e AS (SELECT quantile_cont(CAST(hour_pressure AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS qs FROM part),
d AS (SELECT l.*, CAST(CAST(hour_pressure AS DOUBLE) >= qs[1] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[2] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[3] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[4] AS INTEGER) AS q FROM long l, e),
rv AS (SELECT * FROM d WHERE task = 'revert' AND label >= 0),
mv AS (SELECT * FROM d WHERE task = 'mev'),
{curve_sql('rc', 'rv', 'run_id, q')},
{curve_sql('mc', 'mv', 'run_id, q')},
rn AS (SELECT run_id, q, count(*) AS n_rev, sum(label) AS p_rev FROM rv GROUP BY ALL),
mn AS (SELECT run_id, q, count(*) AS n_mev, sum(label) AS p_mev FROM mv GROUP BY ALL),
sp AS (SELECT DISTINCT run_id, CAST(i AS INTEGER) AS q FROM long, range(5) r(i))
SELECT run_id, q,
  round(CASE WHEN coalesce(n_rev, 0) >= 10 AND p_rev > 0 AND p_rev < n_rev THEN rc_m.auc ELSE 0.5 END, 6)
    AS revert_auc,
  round(CASE WHEN p_mev >= 1 AND p_mev < n_mev THEN mc_m.ap ELSE 0.0 END, 6) AS mev_pr_auc
FROM sp LEFT JOIN mn USING (run_id, q) LEFT JOIN mc_m USING (run_id, q) LEFT JOIN rn USING (run_id, q)
  LEFT JOIN rc_m USING (run_id, q)""")
def q_pressure_quintiles(spark, sf_dir):
    """M13 + A5: revert AUC and MEV AP per pressure quintile per run."""
    rows = dataset_hourly(spark, sf_dir).where(F.col("split") == "test")
    return round_doubles(SL.pressure_quintiles(_long(spark, sf_dir), rows, ["run_id"], "hour_pressure"))


@register("dex_per_day", scored_runs_sql(extra=EXTRA_SQL, columns=HOUR_SQL) + f""",
mv AS (SELECT * FROM long WHERE task = 'mev'
       UNION ALL SELECT 'calls_only' AS run_id, l.* EXCLUDE (run_id) FROM long l
       WHERE l.task = 'mev' AND l.run_id = 'blend_a'
         AND l.tx_id IN (SELECT tx_id FROM part WHERE to_addr_hash <> 0)),
nn AS (SELECT count(*) AS n_all, min(row_idx) AS i0 FROM part),
d AS (SELECT mv.*, CAST((7 * (row_idx - i0 + 1) + n_all - 1) // n_all - 1 AS INTEGER) AS day
      FROM mv, nn WHERE is_dex_candidate),
{curve_sql('c', 'd', 'run_id, day')},
top AS (SELECT run_id, day, label,
          row_number() OVER (PARTITION BY run_id, day ORDER BY score DESC, tx_id) AS rn FROM d),
h AS (SELECT run_id, day, sum(CASE WHEN rn <= 50 THEN label ELSE 0 END) AS h50,
             sum(CASE WHEN rn <= 100 THEN label ELSE 0 END) AS h100 FROM top GROUP BY ALL),
t AS (SELECT run_id, day, count(*) AS n_dex, CAST(sum(label) AS BIGINT) AS n_pos FROM d GROUP BY ALL)
SELECT run_id, day, n_dex, n_pos, round(h100 / least(100, n_dex), 6) AS p_at_100,
  round(h50 / least(50, n_dex), 6) AS p_at_50,
  round(CASE WHEN n_pos >= 1 AND n_pos < n_dex THEN ap END, 6) AS pr_auc
FROM t JOIN h USING (run_id, day) LEFT JOIN c_m USING (run_id, day)""")
def q_dex_per_day(spark, sf_dir):
    """M14 + W8 + P10: day-by-day DEX P@100 / P@50 / AP over 7 equal-count days of the
    split, for the stored runs and for a model that scores no contract creations."""
    ds = dataset_hourly(spark, sf_dir).where(F.col("split") == "test")
    long = M.unpivot_tasks(scored_runs(spark, sf_dir, ds=ds, extra=[*EXTRA, "to_addr_hash"]),
                           keep=["run_id", "tx_id", "to_addr_hash", *EXTRA])
    mev = long.where(F.col("task") == "mev")
    # the same rows once more under the other run's name
    runs = F.when((F.col("run_id") == "blend_a") & (F.col("to_addr_hash") != 0),
                  F.array("run_id", F.lit("calls_only"))).otherwise(F.array("run_id"))
    return round_doubles(SL.dex_per_day(mev.withColumn("run_id", F.explode(runs)), ds.select("row_idx"), ["run_id"]))


@register("posthoc_quartile_bundle", scored_runs_sql(extra=EXTRA_SQL, columns=HOUR_SQL) + f""",
e AS (SELECT quantile_cont(CAST(hour_pressure AS DOUBLE), [0.25, 0.5, 0.75]) AS qs FROM part),
lq AS (SELECT l.*, 1 + CAST(CAST(hour_pressure AS DOUBLE) >= qs[1] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[2] AS INTEGER)
        + CAST(CAST(hour_pressure AS DOUBLE) >= qs[3] AS INTEGER) AS quartile FROM long l, e)"""
          + bundle_sql("run_id, quartile", src="lq"))
def q_posthoc_quartiles(spark, sf_dir):
    """The full metric bundle per run and traffic quartile (quartiles of the split)."""
    long = _long(spark, sf_dir)
    rows = dataset_hourly(spark, sf_dir).where(F.col("split") == "test")
    edges = SL.quantile_edges(rows, "hour_pressure", [0.25, 0.5, 0.75])
    lq = SL.with_strata(long, "hour_pressure", [], "quartile", offset=1, edges=edges)
    return round_doubles(M.metric_bundle(lq, by=["run_id", "quartile"]))


# ---------------------------------------------------------------------------
def _boot_sql(reps: int = BOOT_REPS, seed: int = SEED) -> str:
    w = replicate_weight_sql(seed, "tx_id", "rep")
    keys = "run_id, task, rep"
    f1 = lambda src, wt: f"""SELECT {keys}, CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END AS value
      FROM (SELECT {keys}, CAST(sum(CASE WHEN score > 0.5 AND label = 1 THEN {wt} ELSE 0 END) AS DOUBLE) tp,
                   CAST(sum(CASE WHEN score > 0.5 AND label = 0 THEN {wt} ELSE 0 END) AS DOUBLE) fp,
                   CAST(sum(CASE WHEN score <= 0.5 AND label = 1 THEN {wt} ELSE 0 END) AS DOUBLE) fn
            FROM {src} GROUP BY ALL)"""  # noqa: E731

    def pk(src, k):
        return f"""SELECT {keys}, h / least({k}, nw) AS value FROM (
        SELECT {keys}, sum(greatest(least(w, {k} - coalesce(bef, 0)), 0) * label) AS h FROM (
          SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) bef
          FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, tx_id) rn FROM {src})
          WHERE rn <= {k}) GROUP BY ALL) JOIN (SELECT {keys}, CAST(sum(w) AS DOUBLE) nw FROM {src} GROUP BY ALL)
        USING ({keys})"""
    return scored_runs_sql() + f""",
v AS (SELECT * FROM long WHERE label >= 0),
st AS (SELECT run_id, task, count(*) AS n, sum(label) AS p FROM v GROUP BY ALL),
vv AS (SELECT v.* FROM v JOIN st USING (run_id, task)
       WHERE (task <> 'mev' AND n >= 10) OR (task = 'mev' AND p >= 1)),
p0 AS (SELECT vv.*, 0 AS rep, 1 AS w FROM vv),
bw AS (SELECT vv.*, r.range AS rep, {w} FROM vv CROSS JOIN range({reps}) r),
b AS (SELECT * FROM bw WHERE w > 0),
{curve_sql('pc', 'p0', keys, 'w')},
{curve_sql('bc', 'b', keys, 'w')},
vals AS (
  SELECT run_id, task, 'f1' AS m, 0 AS is_boot, value FROM ({f1('p0', 'w')}) WHERE task <> 'mev'
  UNION ALL SELECT run_id, task, 'f1', 1, value FROM ({f1('b', 'w')}) WHERE task <> 'mev'
  UNION ALL SELECT run_id, task, 'auc', 0, auc FROM pc_m WHERE task <> 'mev'
  UNION ALL SELECT run_id, task, 'auc', 1, auc FROM bc_m WHERE task <> 'mev'
  UNION ALL SELECT run_id, task, 'pr_auc', 0, ap FROM pc_m WHERE task = 'mev'
  UNION ALL SELECT run_id, task, 'pr_auc', 1, ap FROM bc_m WHERE task = 'mev'
  UNION ALL SELECT run_id, task, 'p_at_100', 0, value FROM ({pk('p0', 100)}) WHERE task = 'mev'
  UNION ALL SELECT run_id, task, 'p_at_100', 1, value FROM ({pk('b', 100)}) WHERE task = 'mev'
  UNION ALL SELECT run_id, task, 'p_at_1000', 0, value FROM ({pk('p0', 1000)}) WHERE task = 'mev'
  UNION ALL SELECT run_id, task, 'p_at_1000', 1, value FROM ({pk('b', 1000)}) WHERE task = 'mev'),
pt AS (SELECT run_id, task, m, value AS point FROM vals WHERE is_boot = 0),
qq AS (SELECT run_id, task, m, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
       FROM vals WHERE is_boot = 1 AND value IS NOT NULL GROUP BY ALL)
SELECT run_id, task, task || '_' || m AS metric, round(point, 6) AS point,
       round(coalesce(lo, point), 6) AS lower, round(coalesce(hi, point), 6) AS upper
FROM pt LEFT JOIN qq USING (run_id, task, m)"""


@register("bootstrap_ci", _boot_sql())
def q_bootstrap_ci(spark, sf_dir):
    """M15 + M16 + T7: point and 95 % percentile interval per run, task and metric
    from 100 Poisson(1) resamples (seed 42)."""
    long = M.unpivot_tasks(scored_runs(spark, sf_dir), keep=["run_id", "tx_id"])
    return round_doubles(metric_bundle_ci(long, BOOT_REPS, SEED, by=["run_id"]))


def _cal_sql() -> str:
    val = scored_runs_sql("val")
    test = scored_runs_sql("test")
    # reuse the CTE chains under distinct names
    body_v = val[len("WITH "):].replace("part AS", "vpart AS").replace("FROM part", "FROM vpart") \
        .replace("runs AS", "vruns AS").replace("FROM runs", "FROM vruns").replace("scored AS", "vscored AS") \
        .replace("FROM scored", "FROM vscored").replace("long AS", "vlong AS").replace("JOIN part", "JOIN vpart")
    body_t = test[test.index("part AS"):]
    body_t = body_t.replace("thr AS (", "thr2 AS (", 1)
    return "WITH " + body_v + ",\n" + body_t + """,
vv AS (SELECT * FROM vlong WHERE task IN ('revert', 'drop') AND label >= 0),
g AS (SELECT run_id, task, score, count(*) AS n, sum(label) AS pos FROM vv GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY run_id, task ORDER BY score DESC ROWS UNBOUNDED PRECEDING) ctp,
                sum(n) OVER (PARTITION BY run_id, task ORDER BY score DESC ROWS UNBOUNDED PRECEDING) cn FROM g),
t AS (SELECT run_id, task, sum(pos) AS tp_all, sum(n) AS n_all FROM g GROUP BY ALL),
f AS (SELECT run_id, task, score, 2 * ctp / CAST(cn + tp_all AS DOUBLE) AS f1, tp_all, n_all
      FROM c JOIN t USING (run_id, task)),
best AS (SELECT run_id, task, arg_max(score, (f1, score)) AS bs, max(f1) AS bf,
                max(tp_all) AS tp_all, max(n_all) AS n_all FROM f GROUP BY ALL),
grp AS (SELECT DISTINCT run_id, task FROM vlong WHERE task IN ('revert', 'drop')),
thr_ AS (SELECT run_id, task,
           CASE WHEN n_all >= 10 AND tp_all > 0 THEN bs ELSE 0.5 END AS th,
           CASE WHEN n_all >= 10 AND tp_all > 0 THEN bf ELSE 0.0 END AS vf FROM grp LEFT JOIN best USING (run_id, task)),
tv AS (SELECT l.run_id, l.task, l.score, l.label, th FROM long l JOIN thr_ USING (run_id, task) WHERE l.label >= 0),
tc AS (SELECT run_id, task, sum(CASE WHEN score >= th AND label = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN score >= th AND label = 0 THEN 1 ELSE 0 END) AS fp,
              sum(CASE WHEN score < th AND label = 1 THEN 1 ELSE 0 END) AS fn, count(*) AS nv FROM tv GROUP BY ALL),
rng AS (SELECT run_id, task, min(score) AS mn, max(score) AS mx FROM vlong GROUP BY ALL)
SELECT run_id, task, round(coalesce(th, 0.5), 6) AS val_optimal_threshold, round(coalesce(vf, 0.0), 6) AS val_f1_at_threshold,
  round(CASE WHEN tp > 0 AND nv >= 10 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS test_f1,
  round(mn, 6) AS val_score_min, round(mx, 6) AS val_score_max
FROM thr_ LEFT JOIN tc USING (run_id, task) LEFT JOIN rng USING (run_id, task)"""


@register("f1_calibration", _cal_sql())
def q_f1_calibration(spark, sf_dir):
    """M17 + M18 + M19 + A11 + P14: best-F1 threshold on val, applied to test."""
    ds = dataset(spark, sf_dir)
    keep = ["run_id", "tx_id"]
    val = M.unpivot_tasks(scored_runs(spark, sf_dir, "val", ds=ds), keep=keep)
    test = M.unpivot_tasks(scored_runs(spark, sf_dir, "test", ds=ds), keep=keep)
    sel = F.col("task").isin("revert", "drop")
    return round_doubles(calibrate(val.where(sel), test.where(sel), ["run_id", "task"]))


@register("bootstrap_ci_grouped")
def q_bootstrap_ci_grouped(spark, sf_dir):
    """M15 + M16 at any N: group-level Poisson(n) weights (confusion cells,
    distinct (score, label) groups, top rows + one remainder draw).  Same
    resampling law as ``bootstrap_ci``, other draws: no SQL twin."""
    long = M.unpivot_tasks(scored_runs(spark, sf_dir), keep=["run_id", "tx_id"])
    return round_doubles(metric_bundle_ci(long, BOOT_REPS, SEED, by=["run_id"], method="grouped"))
