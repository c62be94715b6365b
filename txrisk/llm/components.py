"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """k, c: for each node of links (a, b), the least node it is connected with.

    Large stars hang the larger neighbours of a node on its least neighbour,
    small stars the smaller ones; both keep components and halve their depth,
    until links point from each node to the least one.  A node's neighbours are
    never gathered: minima are aggregated and joined back.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "cc-edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        edges = materialize(_small_star(_large_star(edges)), "cc-edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("k")).distinct().select("k", F.col("k").alias("c"))
    return edges.select(F.col("u").alias("k"), F.col("v").alias("c")).union(roots)


def extend_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """k, c: ``comp`` (k, c, as connected_components gives it) with more links.

    Only links between different components are followed, as links between
    their names; no old link is read again.  Null ends of links are not allowed.
    """
    name = lambda end: comp.select(F.col("k").alias(end), F.col("c").alias("c" + end))
    across = (links.join(name("a"), "a", "left").join(name("b"), "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    more = connected_components(across).select(F.col("k").alias("c"), F.col("c").alias("_c"))
    old = comp.join(more, "c", "left").select("k", F.coalesce("_c", "c").alias("c"))
    fresh = more.select(F.col("c").alias("k"), F.col("_c").alias("c")).join(comp.select("k"), "k", "left_anti")
    return old.union(fresh.select("k", "c"))


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select(F.col("v").alias("k"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("k").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not nodes.agg(F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))).first()[0]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from larger u to smaller v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()
