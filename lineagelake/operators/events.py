"""Events of sampled histories: merging, scoring, timing, splitting.

An occurrence is a row (history_id, segstr, cnval, preval, ord) — one event in one
history.  History statistics are rows (history_id, upper_cost, lower_cost).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cycles
from .ordered import Fold, in_parts, running
from .shared import materialize

KEY = ("segstr", "cnval")
RUN_STRIDE = 10_000


def run_of(history_id: Column) -> Column:
    return F.floor(history_id / RUN_STRIDE).cast("bigint")


def iteration_of(history_id: Column) -> Column:
    return history_id % RUN_STRIDE


def _mean_cost() -> Column:
    return (F.col("upper_cost") + F.col("lower_cost")) / 2


def occurrences_of(edges: DataFrame, stride: int = RUN_STRIDE) -> DataFrame:
    """Occurrences (history_id, segstr, cnval, preval, ord, numsegs, numadjs) of the edges that history files hold.

    edges: as ``readers.histories`` gives them.  A cycle is the edges of one (run, history_id, net, cycle), in the order
    of edge_index; an adjacency comes in both directions, of which the first line counts.  Its text is that of
    the cycle in canonical form, so one event reads the same in all histories, wherever and whichever way it is written;
    copy-number change, prevalence and order are its first edge's.  Histories are numbered run * stride + history_id.  A
    cycle is short, so its edges are gathered in one row; edges without a history or a cycle are left out.
    """
    parts = ["is_adj", "chrom", "start", "strand", "chrom2", "end", "strand2", "value"]
    known = edges.where("history_id IS NOT NULL AND cycle IS NOT NULL AND edge_index IS NOT NULL")
    at = ["run", "history_id", "net", "cycle"]
    once = known.groupBy(*at, "edge_index").agg(F.min_by(F.struct(*parts, "prevalence", "cnval", "ord"), "line_no").alias("e"))
    walks = once.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("edge_index", "e"))).alias("o"))
    chain = F.transform("o", lambda x: F.struct(*(x["e"][c].alias(c) for c in parts)))
    first = F.col("o")[0]["e"]
    count = lambda adj: F.size(F.filter("o", lambda x: x["e"]["is_adj"] == adj)).cast("bigint")
    return walks.select((F.coalesce("run", F.lit(0).cast("bigint")) * stride + F.col("history_id")).alias("history_id"), cycles.cycle_text(cycles.canonical(chain)).alias("segstr"), first["cnval"].alias("cnval"), first["prevalence"].alias("preval"), first["ord"].alias("ord"), count(False).alias("numsegs"), count(True).alias("numadjs"))


def total_weight(stats: DataFrame, k: float = 0.0) -> Column:
    """Sum of exp(-k * mean cost) over the histories whose upper and mean cost are not zero, as a
    scalar subquery: it is computed once, within the query that uses it."""
    return stats.where((F.col("upper_cost") > 0) & (_mean_cost() != 0)).agg(F.coalesce(F.sum(F.exp(-k * _mean_cost())), F.lit(0.0)).alias("total")).scalar()


def likelihood(occurrences: DataFrame, stats: DataFrame, k: float = 0.0, total: Column | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per event: numhists (distinct histories) and likelihood, the weight of those whose mean
    cost is not zero over the total weight (null where the total is zero)."""
    total = total_weight(stats, k) if total is None else total
    held = occurrences.select(*key, "history_id").distinct()
    costed = held.join(stats.select("history_id", _mean_cost().alias("cost")), "history_id", "left")
    weight = F.when(F.col("cost") != 0, F.exp(-k * F.col("cost"))).otherwise(0.0)
    return costed.groupBy(*key).agg(F.count(F.lit(1)).alias("numhists"), F.try_divide(F.sum(weight), total).alias("likelihood"))


def timing(occurrences: DataFrame, stats: DataFrame, k: float = 0.0, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per event: mean and population standard deviation of prevalence and order, each
    history weighted by exp(-k * upper cost).  One pass: sums of w, w x and w x^2."""
    w = F.exp(-k * F.col("upper_cost"))
    rows = occurrences.join(stats.select("history_id", "upper_cost"), "history_id").withColumn("w", w)
    sums = rows.groupBy(*key).agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.pow(F.col(c).cast("double"), F.lit(p))).alias(f"{c}{p}") for c in ("preval", "ord") for p in (1, 2)))
    out = [F.col(c) for c in key]
    for c, name in (("preval", "preval"), ("ord", "order")):
        mean = F.col(f"{c}1") / F.col("w")
        out += [mean.alias(f"{name}_mean"), F.sqrt(F.greatest(F.col(f"{c}2") / F.col("w") - mean * mean, F.lit(0.0))).alias(f"{name}_sd")]
    return sums.select(*out)


def run_counts(occurrences: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per event: in how many runs it occurs, and "run:histories" of every run up to its last one
    (0 where it does not occur), joined by commas."""
    per_run = occurrences.select(*key, "history_id").distinct().groupBy(*key, run_of(F.col("history_id")).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    held = per_run.groupBy(*key).agg(F.count(F.lit(1)).alias("num_runs"), F.map_from_entries(F.collect_list(F.struct("run", "n"))).alias("m"), F.max("run").alias("last"))
    listed = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda r: F.concat_ws(":", r.cast("string"), F.coalesce(F.col("m")[r], F.lit(0)).cast("string")))
    return held.select(*key, "num_runs", F.array_join(listed, ",").alias("counts"))


def merge(occurrences: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Identical events as one row: their occurrences in history order, as an array."""
    return occurrences.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("history_id", "preval", "ord"))).alias("occurrences"))


def summary(occurrences: DataFrame, stats: DataFrame, k: float = 0.0) -> DataFrame:
    """All of an event's figures; event_id is "history.order" of its first occurrence."""
    first = occurrences.groupBy(*KEY).agg(F.min(F.struct("history_id", "ord")).alias("f")).select(*KEY, F.concat_ws(".", F.col("f.history_id").cast("string"), F.col("f.ord").cast("string")).alias("event_id"))
    return first.join(likelihood(occurrences, stats, k), list(KEY)).join(timing(occurrences, stats, k), list(KEY)).join(run_counts(occurrences), list(KEY))


def by_type(occurrences: DataFrame) -> DataFrame:
    """Occurrences keyed by segment string and the sign of the copy number."""
    return occurrences.withColumn("cnval", F.signum("cnval").cast("int"))


def ignoring_copy_number(occurrences: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences with copy number 0: of the rows of one edge in one history, the first stays."""
    first = F.row_number().over(Window.partitionBy("segstr", "history_id").orderBy("cnval", "preval", "ord", *tie))
    return occurrences.withColumn("n_", first).where("n_ = 1").drop("n_").withColumn("cnval", F.lit(0))


def split_duplicates(occurrences: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Add ``copy``: an event that occurs n times in a history keeps there the occurrence of
    largest prevalence (copy 0); the others, by rising prevalence, belong to copies 1, 2, ..."""
    same = Window.partitionBy(*KEY, "history_id")
    place = F.row_number().over(same.orderBy("preval", "ord", *tie))
    return occurrences.withColumn("p_", place).withColumn("n_", F.count(F.lit(1)).over(same)).withColumn("copy", F.when(F.col("p_") == F.col("n_"), 0).otherwise(F.col("p_"))).drop("p_", "n_")


def first_of_cycle_order(edges: DataFrame, event: tuple[str, ...], cycle_order: str, line: tuple[str, ...]) -> DataFrame:
    """One row per place of an event's cycle: the first by file line (adjacencies come twice)."""
    n = F.row_number().over(Window.partitionBy(*event, cycle_order).orderBy(*line))
    return edges.withColumn("n_", n).where("n_ = 1").drop("n_")


def sequence_ids(lines: DataFrame, by: tuple[str, ...], line: tuple[str, ...]) -> DataFrame:
    """Add event_seq, which steps when (history_id, ord) changes from line to line, and
    history_seq, which steps when history_id does."""
    order = Window.partitionBy(*by).orderBy(*line)
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new_history = F.lag("history_id").over(order).isNull() | (F.lag("history_id").over(order) != F.col("history_id"))
    new_event = new_history | (F.lag("ord").over(order) != F.col("ord"))
    return lines.withColumn("h_", new_history.cast("int")).withColumn("e_", new_event.cast("int")).withColumn("event_seq", F.sum("e_").over(to_here)).withColumn("history_seq", F.sum("h_").over(to_here)).drop("h_", "e_")


def breakpoint_counts(ends: DataFrame, true_history: int) -> DataFrame:
    """Per breakpoint (chrom, pos) of rows (chrom, pos, event, history_id): events predicted
    (held by any other history) and true (held by ``true_history``)."""
    per = ends.groupBy("chrom", "pos", "event").agg(F.max((F.col("history_id") != true_history).cast("int")).alias("p"), F.max((F.col("history_id") == true_history).cast("int")).alias("t"))
    return per.groupBy("chrom", "pos").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))


def links(occurrences: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Links from each event to the next by mean prevalence within each history:
    segstr, cnval, next_segstr, next_cnval, numhists."""
    once = occurrences.groupBy(*KEY, "history_id").agg(F.avg("preval").alias("p"))
    once = materialize(once, "prevalences")
    mean = materialize(once.groupBy(*(F.col(c).alias(f"{c}_") for c in KEY)).agg(F.round(F.avg("p"), 9).alias("m")), "mean-prevalences")
    same = F.col("segstr").eqNullSafe(F.col("segstr_")) & F.col("cnval").eqNullSafe(F.col("cnval_"))
    ranked = once.join(mean, same).select(*KEY, "history_id", "m")
    by, order = ["history_id"], ["m", *KEY]
    pairs = running(in_parts(ranked, by, order), by, order, {"f": Fold("last", F.struct(*KEY), own=False)}, reverse=True).where("f IS NOT NULL")
    return pairs.groupBy(*KEY, F.col("f.segstr").alias("next_segstr"), F.col("f.cnval").alias("next_cnval")).agg(F.count(F.lit(1)).alias("numhists"))


def cancel_shared(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two events' occurrences without the histories that both have."""
    return a.join(b.select("history_id").distinct(), "history_id", "left_anti"), b.join(a.select("history_id").distinct(), "history_id", "left_anti")
