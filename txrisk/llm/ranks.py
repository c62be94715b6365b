"""Exact ranks within keys without putting a key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000
_FINE = 1 << 30


def rank_within(rows: DataFrame, key: str, counts: dict, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rows`` with ``rank`` (long, gapless from 0 within each ``key``).

    ``rows`` is a materialized table with a unique long ``rid``; ``counts`` has
    the rows of every key (the keys are few and known).  A key's rows are dealt
    to ceil(count / per_bucket) buckets by a hash of ``rid``; ranks are counted
    in a bucket, and buckets are offset by the counts of those before.
    """
    spark = rows.sparkSession
    buckets = spark.createDataFrame(
        [(k, -(-n // per_bucket)) for k, n in counts.items()] or [(0, 1)], "_key long, _buckets long")
    dealt = (rows.join(F.broadcast(buckets), rows[key].cast("long") == F.col("_key"))
             .withColumn("_b", F.expr(f"(pmod(xxhash64(rid), {_FINE}L) * _buckets) div {_FINE}L"))
             .drop("_key", "_buckets"))
    sizes = dealt.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy(F.xxhash64("rid"), "rid"))
    return (dealt.withColumn("_place", place).join(offsets, [key, "_b"])
            .withColumn("rank", (F.col("_off") + F.col("_place") - 1).cast("long"))
            .drop("_b", "_off", "_place"))
