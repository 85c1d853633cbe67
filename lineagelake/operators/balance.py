"""Flows of a graph made to balance: weighted least squares by a distributed conjugate gradient.

A flow balances where the bonds at a node (a loop counts twice) add up to its segment.  Every flow may be
corrected at a price, its precision; every node's remaining error has a price, too.  The corrections that cost least
solve (D + w A'A) c = w A'y, with D the precisions, A a row a node, y the nodes' errors.  A is kept as a table of
its entries (node, var, coef); a round multiplies by it with two equality joins and two sums, so no node, component
or matrix is brought to one task.  The driver sees four sums a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, materialize_with, release

# fixed values of the model: the standard deviation of a segment, the least one of a bond, that of a
# missing bond where chains are balanced, and the weight of a node's error
SEGMENT_DEVIATION, LEAST_BOND_DEVIATION, MISSING_DEVIATION, NODE_WEIGHT = 1e-3, 10.0, 1e3, 1.0


@lean
def least_squares(variables: DataFrame, entries: DataFrame, targets: DataFrame, weight: float = NODE_WEIGHT, tolerance: float = 1e-10, max_rounds: int = 2000) -> DataFrame:
    """(var, value) that minimises sum(precision * value**2) + weight * sum((entries * value - target)**2).

    variables: var, precision (null or negative: none, the value is free); entries: node, var, coef; targets: node,
    target.  Values that nothing determines come as small as possible.  Rounds end when the residual is ``tolerance`` of
    its start, in the norm of the preconditioner (the diagonal); more than ``max_rounds`` raise.
    """
    entries = materialize(entries.groupBy("node", "var").agg(F.sum("coef").cast("double").alias("coef")), "entries")
    through = lambda column, by: entries.join(column, by)
    pulled = through(targets.groupBy("node").agg(F.sum("target").cast("double").alias("target")), "node").groupBy("var").agg((weight * F.sum(F.col("coef") * F.col("target"))).alias("b"))
    squares = entries.groupBy("var").agg((weight * F.sum(F.col("coef") * F.col("coef"))).alias("own"))
    precision = F.greatest(F.coalesce(F.col("precision").cast("double"), F.lit(0.0)), F.lit(0.0))
    now = variables.select("var", precision.alias("d")).join(pulled, "var", "left").join(squares, "var", "left").fillna(0.0, ["b", "own"])
    diagonal = F.col("d") + F.col("own")
    now = now.select("var", "d", F.when(diagonal > 0, diagonal).otherwise(1.0).alias("m"), F.lit(0.0).alias("x"), F.col("b").alias("r"))
    now = materialize(now.withColumn("p", F.col("r") / F.col("m")), "corrections")
    start, last = None, now
    for _ in range(max_rounds):
        along = materialize(through(now.select("var", "p"), "var").groupBy("node").agg(F.sum(F.col("coef") * F.col("p")).alias("t")), "along")
        back = through(along, "node").groupBy("var").agg((weight * F.sum(F.col("coef") * F.col("t"))).alias("s"))
        r, p, q, m = (F.col(c) for c in "rpqm")
        step, sums = materialize_with(now.join(back, "var", "left").withColumn("q", F.col("d") * F.col("p") + F.coalesce("s", F.lit(0.0))).drop("s"), "corrections", pq=F.sum(p * q), rr=F.sum(r * r / m), rq=F.sum(r * q / m), qq=F.sum(q * q / m))
        release(along, last)
        last = step
        pq, rr, rq, qq = (sums[c] or 0.0 for c in ("pq", "rr", "rq", "qq"))
        start = rr if start is None else start
        if rr <= tolerance**2 * start or pq <= 0:
            return step.select("var", F.col("x").alias("value"))
        alpha = rr / pq
        after = max(rr - 2 * alpha * rq + alpha * alpha * qq, 0.0)
        residual = r - alpha * q
        now = step.select("var", "d", "m", (F.col("x") + alpha * p).alias("x"), residual.alias("r"), (residual / m + (after / rr) * p).alias("p"))
    raise RuntimeError(f"no solution in {max_rounds} rounds")


def _name(kind: str, *of: str) -> Column:
    ends = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in of]
    return F.concat_ws("|", F.lit(kind), F.length(ends[0]).cast("string"), *ends)


def _bonds(bonds: DataFrame, missing: float | None) -> DataFrame:
    """(var, u, v, flow, estimate, precision): parallel bonds are one; a negative or null flow is a missing one."""
    one = bonds.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("flow").cast("double").alias("flow")).groupBy("u", "v").agg(F.sum(F.when(F.col("flow") >= 0, F.col("flow"))).alias("flow"))
    deviation = F.greatest("flow", F.lit(LEAST_BOND_DEVIATION))
    none = F.lit(None).cast("double") if missing is None else F.lit(1 / missing**2)
    return one.select(_name("bond", "u", "v").alias("var"), "u", "v", "flow", F.coalesce("flow", F.lit(0.0)).alias("estimate"), F.when(F.col("flow").isNull(), none).otherwise(1 / (deviation * deviation)).alias("precision"))


def _solve(carriers: DataFrame, held: DataFrame, bonds: DataFrame, tolerance: float) -> DataFrame:
    """(var, value) for carriers (var, estimate, precision), each held by nodes (node, var), and bonds."""
    loops = F.col("u") == F.col("v")
    ends = F.array(F.struct(F.col("u").alias("node"), F.when(loops, 2.0).otherwise(1.0).alias("coef")), F.struct(F.when(~loops, F.col("v")).alias("node"), F.lit(1.0).alias("coef")))
    entries = bonds.select("var", F.explode(ends).alias("e")).select("e.node", "var", "e.coef").where("node IS NOT NULL").unionByName(held.select("node", "var", F.lit(-1.0).alias("coef")))
    entries = materialize(entries, "entries")
    variables = materialize(bonds.select("var", "estimate", "precision").unionByName(carriers.select("var", "estimate", "precision")), "variables")
    targets = entries.join(variables, "var").groupBy("node").agg((-F.sum(F.col("coef") * F.col("estimate"))).alias("target"))
    return least_squares(variables, entries, targets, tolerance=tolerance)


@lean
def balance(segments: DataFrame, bonds: DataFrame, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Segments (node, twin, phase, flow) and bonds (u, v, flow) with the corrections that cost least.

    segments: a row a phase and pair of nodes; the phases of one pair share its correction in proportion to
    their flows, the first takes it all where they have none.  bonds: parallel ones count as one, a negative or null flow
    is missing: estimated as nothing, at no price.  A bond costs by max(flow, 10), a segment hardly gives.
    """
    pairs = segments.select(F.least("node", "twin").alias("node"), F.greatest("node", "twin").alias("twin"), "phase", F.col("flow").cast("double").alias("flow"))
    pairs = materialize(pairs.groupBy("node", "twin", "phase").agg(F.sum("flow").alias("flow")), "segments")
    whole = pairs.groupBy("node", "twin").agg(F.sum("flow").alias("estimate"), F.min("phase").alias("first"))
    # numbered while they are written: even ones are segments, odd ones bonds
    number = F.monotonically_increasing_id() * 2
    whole = materialize(whole.select(number.alias("var"), "node", "twin", F.coalesce("estimate", F.lit(0.0)).alias("estimate"), "first", F.lit(1 / SEGMENT_DEVIATION**2).alias("precision")), "segment-sums")
    held = whole.select("var", F.explode(F.array_distinct(F.array("node", "twin"))).alias("node"))
    linked = materialize(_bonds(bonds, None).withColumn("var", number + 1), "bonds")
    found = _solve(whole, held, linked, tolerance)
    given = F.coalesce("flow", F.lit(0.0))
    share = F.when(F.col("estimate") > 0, given + F.col("value") * given / F.col("estimate")).when(F.col("phase").eqNullSafe(F.col("first")), F.col("value")).otherwise(given)
    corrected = pairs.join(whole.select("node", "twin", "var", "estimate", "first"), ["node", "twin"]).join(found, "var").select("node", "twin", "phase", share.alias("flow"))
    return corrected, linked.join(found, "var").select("u", "v", (F.col("estimate") + F.col("value")).alias("flow"))


@lean
def balance_chains(segments: DataFrame, bonds: DataFrame, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """(chain, flow) and bonds (u, v, flow): as ``balance``, with one flow a chain.

    segments: node, twin, chain, length, flow.  A chain's estimate is the mean flow of its segments by length; missing
    bonds are held to nothing loosely.
    """
    rows = segments.select("node", "twin", "chain", F.col("length").cast("double").alias("length"), F.col("flow").cast("double").alias("flow"))
    chains = rows.groupBy("chain").agg(F.coalesce(F.try_divide(F.sum(F.col("flow") * F.col("length")), F.sum("length")), F.lit(0.0)).alias("estimate"))
    chains = materialize(chains.select(_name("chain", "chain").alias("var"), "chain", "estimate", F.lit(1 / SEGMENT_DEVIATION**2).alias("precision")), "chains")
    held = rows.select(_name("chain", "chain").alias("var"), F.explode(F.array_distinct(F.array("node", "twin"))).alias("node"))
    linked = materialize(_bonds(bonds, MISSING_DEVIATION), "bonds")
    found = _solve(chains, held, linked, tolerance)
    return chains.join(found, "var").select("chain", (F.col("estimate") + F.col("value")).alias("flow")), linked.join(found, "var").select("u", "v", (F.col("estimate") + F.col("value")).alias("flow"))
