"""Sequence graphs as edge tables: components, flow balance, degrees, covers.

Segment edges are rows (node, twin, flow); bonds are rows (u, v, flow).  All steps are
joins and aggregates over these tables, so a graph may be larger than one machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, materialize_with, release


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


@lean
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each connected component, for nodes of an edge (u, v).

    Alternates the large-star and small-star steps until the edges are stars: each step is a
    partial aggregate and an equality join, each round is written to the shared folder.  Null ends,
    loops and repeated edges link nothing new; a node with loops alone is its own component.
    """
    # loops are written with the others: what made the edges runs once
    given = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    alone, edges = materialize(given.where("u = v").select(F.col("u").alias("node")), "loops"), given.where("u <> v")
    before, last = None, given
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that adaptive execution can split the rows of a part's centre
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "least-neighbours")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialize(large, "links")
        release(low, last)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("low")), "least-neighbours")
        small = large.join(low, "u").select("u", "v", "low")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct(F.col("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges, now = materialize_with(small, "links", n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        release(low, large)
        last = edges
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    linked = found.unionByName(roots)
    return linked.unionByName(alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))


def imbalance(segments: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per node: segment flow, bond flow (a loop counts twice) and the error between them."""
    seg = segments.select("node", "flow").unionByName(segments.where("twin <> node").select(F.col("twin").alias("node"), "flow")).groupBy("node").agg(F.sum("flow").alias("segment_flow"))
    ends = bonds.select(F.col("u").alias("node"), "flow").unionByName(bonds.select(F.col("v").alias("node"), "flow")).groupBy("node").agg(F.sum("flow").alias("bond_flow"))
    both = seg.join(ends, "node", "full")
    return both.select("node", F.coalesce("segment_flow", F.lit(0.0)).alias("segment_flow"), F.coalesce("bond_flow", F.lit(0.0)).alias("bond_flow")).withColumn("error", F.abs(F.col("segment_flow") - F.col("bond_flow")))


def scale_bonds_down(segments: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds scaled so that neither end carries more bond flow than segment flow."""
    room = imbalance(segments, bonds).select("node", F.when(F.col("bond_flow") > F.col("segment_flow"), F.try_divide("segment_flow", "bond_flow")).otherwise(1.0).alias("f"))
    at_u, at_v = room.select(F.col("node").alias("u"), F.col("f").alias("fu")), room.select(F.col("node").alias("v"), F.col("f").alias("fv"))
    return bonds.join(at_u, "u").join(at_v, "v").withColumn("flow", F.col("flow") * F.least("fu", "fv")).drop("fu", "fv")


def net_connections(segments: DataFrame, membership: DataFrame) -> DataFrame:
    """Pairs of groups that segment edges connect, with how many do; membership: node, component."""
    a = membership.select(F.col("node"), F.col("component").alias("a"))
    b = membership.select(F.col("node").alias("twin"), F.col("component").alias("b"))
    return segments.join(a, "node").join(b, "twin").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("blocks"))
