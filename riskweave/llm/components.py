"""Connected components by alternating large-star and small-star steps (public algorithm, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, c): for each vertex of ``edges`` (a, b) the smallest vertex of its component, as a stage table.

    Each step is written to the shared folder, so lineage stays short, and the tables of
    earlier steps are deleted. A hub's edges are never grouped: its minimum comes from
    partial minima and is written, so that the join back to the edges has plain shuffles
    on both sides, which adaptive execution splits inside a hub.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())

    with common.scratch(spark) as tables:
        now = tables.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        before = state(now)
        while before[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = tables.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-minima")
            large = tables.written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
            least = large.groupBy("u").agg(F.min("v").alias("m"))  # no hubs here: u is the larger vertex, and its edges lead to minima
            moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = tables.written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
            tables.drop(keep=1)
            after = state(now)
            if after == before:
                break
            before = after
        return tables.kept(now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select("v", F.col("v").alias("c")).distinct()), name)
