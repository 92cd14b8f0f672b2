"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.llm.shared import drop, written


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _joined(e: DataFrame, least: DataFrame, label: str, out) -> DataFrame:
    """The step's edges, written; the minima are a table first, so that Spark can split a node with many edges."""
    held = written(least, f"{label}-minima")
    new = written(out(e.join(held, F.col("u") == F.col("k")), held).where("u <> v").distinct(), label)
    drop(held)
    return new


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k")
    return _joined(both.where("v > u"), least, "large", lambda j, _: j.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    own = lambda held: held.select(F.col("k").alias("u"), F.col("m").alias("v"))
    return _joined(down, least, "small", lambda j, held: j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own(held)))


def _all_stars(e: DataFrame) -> bool:
    """Whether each node has one edge and no centre has any: then a further round changes nothing."""
    if not e.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge (u, v) to another, but the smallest of its component, with that smallest.

    Every step is a written table, so lost executors cost one step at most; a step's input is deleted after
    it.  No edges give no rows.
    """
    e = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while True:
        large = _large_star(e)
        small = _small_star(large)
        drop(e, large)
        e = small
        if _all_stars(e):
            return e
