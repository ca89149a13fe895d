"""Connected components of a graph whose edges are a DataFrame; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.tables import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """The least of each node and its neighbours in edges."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both_ways(edges)
    return around.join(_least(around), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges (u, v) lead to, for every node of an edge.

    Every round ties the neighbours of a node to the least of them, first the larger ones and then the smaller; the
    number of edges does not grow, and rounds end when nothing changes. Each round is written to the shared folder.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)))
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
