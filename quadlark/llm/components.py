"""Connected components by alternating large-star and small-star steps; only DataFrames, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_table, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    onto = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onto.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): every node of a link with the least node it reaches, itself included.

    Self-links vanish; nodes without links are absent; no links give an empty result. Rounds end when the set of
    links (its count and hash sum) no longer changes: then each component is a star around its least node. The number
    of links never grows, and each round is written to the shared folder, so a lost executor repeats one round at most.
    """
    spark = edges.sparkSession
    now, at = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        after, to = written(_small_star(_large_star(now)))
        drop_table(spark, at)
        now, at = after, to
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
