"""Sinks and keyed hand-off tables.

Every table is keyed (tx_id, run_id, split) instead of aligned by row
position, and written under a shared folder (the session's
``spark.checkpoint.dir`` by default), so a lost executor only recomputes
its own tasks and later jobs start from the written table.
"""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.scalar import feature_fingerprint
from txrisk.operators.scan import TIME_ROWS_PER_RANGE
from txrisk.session import checkpoint_dir

def _code_version() -> str:
    """Hash of the package source: stored tables are rebuilt whenever the code changes."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.md5()
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:12]


TABLE_VERSION = _code_version()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def write_splits(df: DataFrame, path: str, mode: str = "overwrite", rows: int = 0) -> None:
    """S3: one keyed table partitioned by split.  Range-partitioned on
    (split, time): a large split is written by many tasks, each file covers
    one time range and is sorted inside, so parquet min/max stats prune.  For a table of
    about ``rows`` rows, a task sorts at most TIME_ROWS_PER_RANGE of them."""
    parts = -(-rows // TIME_ROWS_PER_RANGE)
    more = [parts] if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    # the writer needs rows grouped by the partition column: sorting by
    # (split, time) satisfies it, so no second (unstable) sort reorders time
    (df.repartitionByRange(*more, "split", S.SORT_KEY).sortWithinPartitions("split", S.SORT_KEY, "tx_id")
       .write.mode(mode).partitionBy("split").parquet(path))


def split_view(spark: SparkSession, path: str, split: str, part: str = "features") -> DataFrame:
    """The reference's three per-split files as projections of one table."""
    cols = {"features": ["tx_id", *S.FEATURE_COLUMNS], "labels": ["tx_id", *S.LABEL_COLUMNS],
            "dex_mask": ["tx_id", "is_dex_candidate"]}[part]
    return spark.read.parquet(path).where(F.col("split") == split).select(*cols)


def files_key(spark: SparkSession, path: str) -> str:
    """Fingerprint of a table's files: names, sizes and times of change, in one
    aggregate that reads no column."""
    f = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size",
                                        "_metadata.file_modification_time").distinct()
    h = F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")
    r = f.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return f"{r['n']}|{r['h']}"


def materialized(spark: SparkSession, name: str, key: str, build, source: str | None = None,
                 write=None) -> DataFrame:
    """Build a table once per (name, key, files of ``source``) under the shared
    folder and read it back.

    ``build()`` returns the DataFrame; it is written partitioned by ``split``
    when it has that column.  Re-reads skip the build (lineage cut); a ``source``
    table whose files have changed is built anew.  ``write(df, path)`` may lay the
    table out in its own way.
    """
    return spark.read.parquet(materialized_path(spark, name, key, build, source, write))


def materialized_path(spark: SparkSession, name: str, key: str, build, source: str | None = None,
                      write=None) -> str:
    """Where ``materialized`` keeps the table, built if need be."""
    if source is not None:
        key = f"{key}|{files_key(spark, source)}"
    h = hashlib.md5(f"{TABLE_VERSION}|{key}".encode()).hexdigest()[:16]
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{h}")
    if not _exists(spark, path):
        df = build()
        if write is not None:
            write(df, path)
        elif "split" in df.columns:
            write_splits(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
    return path


def manifest_frame(ds: DataFrame, mode: str = "full", audit: str = "passed",
                   features=S.FEATURE_COLUMNS, labels=S.LABEL_COLUMNS) -> DataFrame:
    """S4 as data: rows and label rates per split (one aggregate) plus the
    build's constants (feature hash F17, column lists, audit verdict)."""
    rates = [F.coalesce(F.avg(F.when(F.col(l) >= 0, F.col(l).cast("double"))), F.lit(0.0)).alias(l)
             for l in labels]
    per = ds.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.struct(*rates).alias("label_rates"))
    return per.select(
        F.lit(mode).alias("mode"), "split", "rows", "label_rates",
        F.lit(feature_fingerprint(features)).alias("feature_hash"),
        F.lit(",".join(features)).alias("feature_columns"),
        F.lit(",".join(labels)).alias("label_columns"),
        F.lit(audit).alias("leakage_audit"))


def write_manifest(manifest: DataFrame, path: str) -> dict:
    """The JSON document (a handful of rows: one per split), written through
    Spark so ``path`` may be any shared file system."""
    rows = [r.asDict(recursive=True) for r in manifest.collect()]
    doc = {
        "mode": rows[0]["mode"] if rows else None,
        "total_rows": sum(r["rows"] for r in rows),
        "feature_columns": rows[0]["feature_columns"].split(",") if rows else [],
        "label_columns": rows[0]["label_columns"].split(",") if rows else [],
        "feature_hash": rows[0]["feature_hash"] if rows else None,
        "splits": {r["split"]: {"rows": r["rows"], "label_rates": r["label_rates"]} for r in rows},
        "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"),
        "leakage_audit": rows[0]["leakage_audit"] if rows else None,
    }
    spark = manifest.sparkSession
    spark.createDataFrame([(json.dumps(doc, indent=2),)], "value string") \
         .coalesce(1).write.mode("overwrite").text(path)
    return doc


def write_scores(scores: DataFrame, path: str, mode: str = "append") -> None:
    """Keyed score table partitioned by (run_id, split)."""
    scores.write.mode(mode).partitionBy("run_id", "split").parquet(path)


def read_scores(spark: SparkSession, path: str, run_id: str | list[str], split: str | None = None) -> DataFrame:
    """The scores of one run or several; raises when a run is absent.  Only
    the partitions of the runs and the split are read."""
    runs = [run_id] if isinstance(run_id, str) else list(run_id)
    df = spark.read.parquet(path).where(F.col("run_id").isin(runs))
    if split is not None:
        df = df.where(F.col("split") == split)
    have = {r[0] for r in df.select("run_id").distinct().collect()}  # at most one row per run
    for r in runs:
        if r not in have:
            raise FileNotFoundError(f"no scores for run_id={r!r} split={split!r} under {path}")
    return df


def upsert_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run_id, slice, metric, value, lower, upper) with a timestamp;
    an update is a newer row, never an in-place rewrite."""
    cols = {"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double"),
            "slice": F.lit("all")}
    m = metrics.withColumns({k: v for k, v in cols.items() if k not in metrics.columns})
    m.select("run_id", "slice", "metric", F.col("value").cast("double"), F.col("lower").cast("double"),
             F.col("upper").cast("double"), F.current_timestamp().alias("computed_at")) \
     .write.mode("append").parquet(path)


def upsert_calibration(cal: DataFrame, path: str) -> None:
    """M19 write-back: per run and task the calibrated test F1 as ``{task}_f1``, its threshold
    (with the val score range as bounds) and the val F1, in slice "f1_calibration"."""
    none = F.lit(None).cast("double")
    row = lambda name, value, low=none, high=none: F.struct(
        F.concat("task", F.lit(name)).alias("metric"), value.alias("value"), low.alias("lower"), high.alias("upper"))
    each = F.explode(F.array(
        row("_f1", F.col("test_f1")), row("_val_f1", F.col("val_f1_at_threshold")),
        row("_threshold", F.col("val_optimal_threshold"), F.col("val_score_min"), F.col("val_score_max"))))
    upsert_metrics(cal.select("run_id", F.lit("f1_calibration").alias("slice"), each.alias("_m"))
                   .select("run_id", "slice", "_m.*"), path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """S8 read side: the newest value per (run_id, slice, metric)."""
    m = spark.read.parquet(path)
    return m.groupBy("run_id", "slice", "metric").agg(
        F.max_by(F.struct("value", "lower", "upper"), "computed_at").alias("_v")) \
        .select("run_id", "slice", "metric", "_v.value", "_v.lower", "_v.upper")


def write_pr_curve(curve: DataFrame, path: str) -> None:
    """Long (run_id, threshold, precision, recall) table."""
    curve.write.mode("overwrite").partitionBy("run_id").parquet(path)
