"""Operator 6: exact duplicates, in DataFrame functions only.

Rows are grouped by a 128-bit content hash and, inside a group, by their bytes, so
texts that merely share a hash fall into different classes.  Partial
aggregation compares the copies of a text where they are read and sends one
row of a class from each task, however many copies there are.  Classes with a large share of all rows (at most
``1 / HOT_SHARE`` of them can exist) are broadcast, the others joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import fresh_name, materialize, sized

HOT_SHARE = 1 / 2048  # a class with more of the rows than this is broadcast


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, keep: str = "max", hash_of=content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    ``keep`` ("max" or "min") names which stable id of equal texts stays.  A
    null text counts as empty and equals it.  Null ids stay only where a group
    has no other id (keep_id is then null).  Of rows that repeat the kept id,
    each is marked kept: they cannot be told apart.  An empty table gives no
    rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashed = rows.withColumn("h", hash_of(F.col("text")))
    best = F.max if keep == "max" else F.min

    slim = materialize(hashed.select("doc_id", "h", F.sha2("text", 256).alias("sha")), "dedup-hashes")
    # copies meet byte by byte where they are read: each task sends a text once
    classes = materialize(
        hashed.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("h", F.sha2("text", 256).alias("sha"), "keep_id", "n"), "dedup-classes")

    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") > F.lit(total * HOT_SHARE)).select("h", "sha", "keep_id", "n")
    rest = classes.where(F.col("n") <= F.lit(total * HOT_SHARE))
    # fewer than 1 / HOT_SHARE classes can exceed the share: the broadcast is bounded
    with_hot = slim.join(F.broadcast(hot.withColumnRenamed("keep_id", "hot_id").withColumnRenamed("n", "hot_n")),
                         ["h", "sha"], "left")
    out = (with_hot.where("hot_n IS NOT NULL")
           .select("doc_id", "sha", F.col("hot_id").alias("keep_id"), F.col("hot_n").alias("n"))
           .unionByName(with_hot.where("hot_n IS NULL").join(rest, ["h", "sha"], "left")
                        .select("doc_id", "sha",
                                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                                F.coalesce("n", F.lit(1)).alias("n"))))
    return out.select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    A null text counts as empty; an empty table gives no rows.  Repeated rows
    (same id and text) are reduced to one; which of rows with equal id and text
    but other columns differing stays is not defined.
    """
    gone_id, gone_sha = (fresh_name(docs.columns, c) for c in ("gone_id", "gone_sha"))
    groups = materialize(exact_groups(docs, keep).where("group_size > 1"), "dedup-groups")
    gone = sized(groups.where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    stay = docs.join(gone, (F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id))) & (sha == F.col(gone_sha)), "left_anti")
    twice = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    return stay if twice.limit(1).count() == 0 else stay.dropDuplicates(["doc_id", "text"])
