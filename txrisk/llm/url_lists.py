"""Operator 7: URL filters as a temporal list join, in DataFrame functions only.

Dated list entries (added, removed) become validity intervals; every capture is
judged by the entries active when it was fetched.  A pattern is a domain, which
covers its subdomains, or a host with a path, which covers paths below it; a
capture's URL gives all patterns that could cover it, and these join on
equality.  Time is cut into bins on both sides of the join, so a pattern with
many intervals meets only those near the fetch time, and a host with many
captures is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.spark_io import materialize

BIN_SECONDS = 30 * 86400


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def patterns_of(url: Column) -> Column:
    """All patterns that cover the URL: its host's domains, and host with each leading path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    upto = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(upto(labels), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(upto(parts), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host.isNotNull(), F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: open) from list, pattern, at, action.

    ``action`` is "add" or "remove"; at equal times an add wins.  Rows with a
    null in any of the four are ignored, repeated entries count once.
    """
    events = (entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
              .groupBy("list", "pattern", "at").agg(F.max(F.col("action") == "add").alias("on")))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    return (events.withColumn("valid_to", F.lead("at").over(w)).where("on")
            .select("list", "pattern", F.col("at").alias("valid_from"), "valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, blocked, n_active, list, pattern, valid_from, valid_to.

    ``captures`` has page_id, url and fetched_at.  ``n_active`` counts the
    intervals that cover the capture; of these the one with the longest pattern
    is named (then the least list, pattern and start).  A null or unreadable
    URL or a null time matches nothing, repeated captures are judged each, an
    empty list blocks nothing, empty captures give no rows; other columns are
    not read.
    """
    rows = materialize(captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                       F.col("fetched_at").cast("timestamp").alias("fetched_at"))
                       .withColumn("rid", F.monotonically_increasing_id()), "url-captures")
    at = lambda t: F.floor(F.unix_seconds(t) / F.lit(BIN_SECONDS))
    ends = rows.agg(F.min(at(F.col("fetched_at"))).alias("a"), F.max(at(F.col("fetched_at"))).alias("b")).first()
    first, last = F.lit(ends["a"] or 0).cast("long"), F.lit(ends["b"] or 0).cast("long")
    spans = (validity(entries.withColumn("at", F.col("at").cast("timestamp")))
             .withColumn("_a", F.greatest(at(F.col("valid_from")), first))
             .withColumn("_b", F.least(F.coalesce(at(F.col("valid_to")), last), last)).where("_a <= _b")
             .withColumn("bin", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b"))
    asked = (rows.where("fetched_at IS NOT NULL")
             .select("rid", "fetched_at", at(F.col("fetched_at")).alias("bin"),
                     F.explode(F.array_distinct(patterns_of(F.col("url")))).alias("pattern")))
    hits = (asked.join(spans, ["pattern", "bin"])
            .where((F.col("valid_from") <= F.col("fetched_at"))
                   & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
            .groupBy("rid").agg(F.count(F.lit(1)).alias("n_active"), F.min(F.struct(
                (-F.length("pattern")).alias("o"), "list", "pattern", "valid_from", "valid_to")).alias("best")))
    return (rows.join(hits, "rid", "left")
            .select("page_id", "url", "fetched_at", F.col("n_active").isNotNull().alias("blocked"),
                    F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                    "best.list", "best.pattern", "best.valid_from", "best.valid_to"))
