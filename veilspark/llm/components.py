"""Connected components of an edge table, by alternating star contractions.

Large star: every neighbour of a node that is larger than the node is linked to
the least of the node and its neighbours. Small star: the smaller neighbours of
a node, and the node itself, are linked to the least of them. Both together
shrink any graph to stars around the least node of each component in a number
of rounds that grows with the logarithm of its size. A star around a hub with
very many edges is handled by aggregating its minimum and joining it back, so
no task gathers a node's neighbours.

Every round is written to the checkpoint folder; lineage never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import with_checkpoints


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _tidy(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the least node reachable.

    Null ends and loops are no edges; repeated edges count once.
    """
    with_checkpoints(edges.sparkSession)
    e = _tidy(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")).checkpoint()
    state = None
    while True:
        new = _tidy(_small(_tidy(_large(e)))).checkpoint()
        # stars: as many edges as nodes that have a smaller neighbour, and the same edges as before
        told = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        e = new
        if told == state:
            break
        state = told
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
