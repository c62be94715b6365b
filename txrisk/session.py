"""SparkSession defaults used by tests, the bench and the examples.

On a cluster the session comes from the platform; only unset options are filled.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "txrisk", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):  # tests and the bench; a platform sizes its own
        conf |= {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    active = SparkSession.getActiveSession()
    if active is not None:  # only what is unset is filled
        have = {k for k, _ in active.sparkContext.getConf().getAll()}
        conf = {k: v for k, v in conf.items() if k not in have and active.conf.get(k, None) is None}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream checkpoints.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset on a
    local master (tests) a scratch folder is created and registered; executors
    elsewhere could not read one, so a cluster has to set it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="txrisk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(d, "rdd"))
    return d


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``txrisk`` importable in Spark's Python workers (pandas UDFs and
    stateful processors reference library functions by module).  The package
    is zipped once per application and added like ``--py-files``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="txrisk-pyfiles-"), "txrisk.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
