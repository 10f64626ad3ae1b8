"""Connected components of an edge table, without any collect to the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def saved(df: DataFrame) -> DataFrame:
    """A Parquet copy in the shared folder; ends the lineage of a round."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/edges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that ``edges`` names; ``component`` is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each replaces a node's edges by edges to its
    smallest neighbour, which needs a logarithmic number of rounds in practice whatever the diameter, so
    chains of any length end in one component. The rounds go on until all edges lead to a smallest node; there is
    no limit to them. Minima are never broadcast (a row for each node, which the driver would have to hold). They are pre-aggregated, so a node with very many edges costs no more than its rows.
    """
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component"))
    e = saved(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _stars(e):
        e = saved(_small_star(_large_star(e)))
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v")).unionAll(loops)
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def _stars(e: DataFrame) -> bool:
    """Whether each larger end has one edge, to a node that is no larger end itself: further rounds would change nothing."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
    others = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
    return others.agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets an edge to the smallest of the node and its neighbours (no more rows than ``e``)."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint("shuffle_hash"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get an edge to the smallest of those."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least.hint("shuffle_hash"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
