"""Alternating shortest paths from many origins at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, materialize_with

#: Flows this small are none.
LEAST_FLOW = 1e-3


def alternating_distances(edges: DataFrame, origins: DataFrame, least_flow: float = LEAST_FLOW) -> DataFrame:
    """(source, node, even, odd): how many pairs of edges lead from each source's origin to each node it reaches.

    edges: u, v, flow, walked both ways; origins: source, origin, value, blocked.  A path's edges alternate: the first
    has flow of the other sign than ``value`` (nought counts as negative), the next of the same sign, and so on.  ``even``
    counts the pairs of paths that end after a pair (0 at the origin), ``odd`` those of paths that end after a pair's
    first edge, that pair included.  ``blocked`` is a node that the first edge must not lead to, null for none.  A node
    that no path ends at in one way has null there; one that none ends at has no row.  Null ends and
    flows are no edges.

    A round joins only the nodes that the round before reached first; what is known stands in one table a
    round, so rounds are as many as the longest distance.
    """
    strong = edges.where(F.abs("flow") > least_flow).select("u", "v", (F.col("flow") > 0).alias("plus"))
    way = materialize(strong.unionByName(strong.select(F.col("v").alias("u"), F.col("u").alias("v"), "plus")).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "ways")
    signed = origins.where("source IS NOT NULL AND origin IS NOT NULL").select("source", "origin", (F.col("value") > 0).alias("plus"), "blocked")
    signed = materialize(signed.dropDuplicates(["source"]), "origins")
    even, found = materialize_with(signed.select("source", F.col("origin").alias("node"), "plus", "blocked"), "frontier", rows=F.count(F.lit(1)))
    known = {0: [even.select("source", "node", F.lit(0).alias("distance"))], 1: []}
    seen = {0: even.select("source", "node"), 1: even.select("source", "node").where("false")}
    distance = 0
    while found["rows"]:
        distance += 1
        front = even
        for parity in (1, 0):
            side = way.select(F.col("u").alias("node"), F.col("v").alias("to"), F.col("plus").alias("sign"))
            sign = F.col("sign") != F.col("plus") if parity else F.col("sign") == F.col("plus")
            open_ = (F.lit(distance > 1 or not parity)) | F.col("blocked").isNull() | (F.col("to") != F.col("blocked"))
            reached = front.join(side, "node").where(sign & open_).select("source", F.col("to").alias("node"), "plus", "blocked").dropDuplicates(["source", "node"])
            front, found = materialize_with(reached.join(seen[parity], ["source", "node"], "left_anti"), "frontier", rows=F.count(F.lit(1)))
            seen[parity] = materialize(seen[parity].unionByName(front.select("source", "node")), "reached")
            known[parity].append(front.select("source", "node", F.lit(distance).alias("distance")))
        even = front
    out = None
    for parity, tables in known.items():
        for t in tables:
            rows = t.select("source", "node", F.when(F.lit(parity == 0), F.col("distance")).alias("even"), F.when(F.lit(parity == 1), F.col("distance")).alias("odd"))
            out = rows if out is None else out.unionByName(rows)
    return out.groupBy("source", "node").agg(F.max("even").alias("even"), F.max("odd").alias("odd"))
