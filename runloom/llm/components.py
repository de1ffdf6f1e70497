"""Connected components of links between integer ids, by alternating large and small stars.

Each round is two aggregations and joins over the links that are left; no vertex's links are gathered in one place, and
what a round gives is written to the shared folder before the next one reads it.  The number of links never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex's greater neighbours go to its least neighbour (or itself)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex and its lesser neighbours go to the least of them.  links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex that a link (a, b) has; component is its least reachable id.  Links with a null
    end and loops are left out; without links the result is empty.  The result is a written table."""
    spark = links.sparkSession
    clean = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = common.staged(clean, "links")
    mark = None
    for _ in range(most_rounds):
        following = common.staged(_small_star(_large_star(current)), "links")
        common.remove(spark, common.path_of(current)) if current.inputFiles() else None
        current = following
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
