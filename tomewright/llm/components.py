"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import drop_table, stage_table


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the least neighbour of each u, as a table: a join with it isn't bound to an aggregate's partitions, so
    that Spark can split a u with many edges."""
    return stage_table(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")


def _star(edges: DataFrame) -> DataFrame:
    """One round over the edges, written: the large star, then the small star."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    large = stage_table(large, "component-edges")
    drop_table(least)
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage_table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
    drop_table(least)
    drop_table(large)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of long ids to (u, v): v is the least id of u's component, for every u but that least one.

    Each round writes its edges to the shared folder; rounds grow with the logarithm of a component's diameter. A
    node with many edges meets its minimum through a partial aggregate, a table and a join that Spark can split. No edges
    give no rows; self-loops and repeated pairs are harmless.
    """
    edges = stage_table(edges.where("u <> v").select("u", "v").distinct(), "component-edges")
    sign = None
    while True:
        new = _star(edges)
        drop_table(edges)
        edges = new
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign or not now[0]:
            return edges
        sign = now
