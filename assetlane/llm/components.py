"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.tables import store


def components(spark: SparkSession, links: DataFrame, known: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """node and comp, the smallest node reachable, for every node of the links (x, y) and of ``known``.

    ``known`` is an earlier result, a stored table: its components count as single nodes, so only the new links are worked on.
    Each step is a map-side combined minimum and a join on one node, so a node with many links is
    split like any skewed join key. The link table shrinks to one star per component and is done
    when it holds nothing but stars.
    """
    if known is not None:
        for end in ("x", "y"):
            named = known.select(F.col("node").alias(end), F.col("comp").alias("into"))
            links = links.join(named, end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
    edges = store(spark, links.where("x <> y").select(
        F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _all_stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(spark, large.where("u <> v").distinct(), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = store(spark, small.where("u <> v").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    found = stars.union(roots)
    if known is not None:
        into = found.select(F.col("node").alias("comp"), F.col("comp").alias("into"))
        moved = known.join(into, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
        found = moved.union(found.join(known, "node", "left_anti").select("node", "comp"))
    return store(spark, found, "components")


def _all_stars(edges: DataFrame) -> bool:
    """Whether no node of the distinct edges (u, v), v below u, has two below it or one below and one above."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    return not seen.where("below > 1 OR (below > 0 AND above > 0)").agg(F.count(F.lit(1)).alias("n")).first()["n"]
