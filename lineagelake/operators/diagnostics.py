"""Diagnostics of sampled histories: order, mixing, convergence, accuracy, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import KEY, iteration_of, run_of
from .numbering import numbered
from .ordered import Fold, in_parts, running
from .shared import materialize


def rank_fractions(occurrences: DataFrame, tie: tuple[str, ...] = (), by: str = "ord") -> DataFrame:
    """Add ``fraction``: each occurrence's place in its history by ``by``, from 0 to 1; the
    only occurrence of a history gets 1.1."""
    group, order = ["history_id"], [by, *(c for c in (*KEY, *tie) if c != by)]
    place = running(in_parts(occurrences, group, order), group, order, {"place_": Fold("count", F.lit(1), own=False)})
    sizes = materialize(occurrences.groupBy(F.col("history_id").alias("of_")).agg(F.count(F.lit(1)).alias("n_")), "history-sizes")
    sized = place.join(sizes, F.col("history_id").eqNullSafe(F.col("of_")))
    fraction = F.when(F.col("n_") == 1, F.lit(1.1)).otherwise(F.col("place_") / F.when(F.col("n_") > 1, F.col("n_") - 1))
    return sized.select(*occurrences.columns, fraction.alias("fraction"))


def early_late(fractions: DataFrame) -> DataFrame:
    """Per event: occurrences in the first half of their history (0.5 included), and others."""
    early = F.col("fraction") <= 0.5
    return fractions.groupBy(*KEY).agg(F.count_if(early).alias("early"), F.count_if(~early).alias("late"))


def order_pairs(occurrences: DataFrame) -> DataFrame:
    """Per pair of events a < b that share histories: in how many a comes first, b comes
    first, or both at once (each event by its least order in a history).

    The join is on the history; pass events already cut by likelihood, as the number of
    pairs grows with the square of the events in a history.
    """
    once = occurrences.groupBy("history_id", *KEY).agg(F.min("ord").alias("o"))
    a = once.select("history_id", F.col("segstr").alias("a_segstr"), F.col("cnval").alias("a_cnval"), F.col("o").alias("a_o"))
    b = once.select("history_id", F.col("segstr").alias("b_segstr"), F.col("cnval").alias("b_cnval"), F.col("o").alias("b_o"))
    later = F.struct("a_segstr", "a_cnval") < F.struct("b_segstr", "b_cnval")
    return a.join(b, "history_id").where(later).groupBy("a_segstr", "a_cnval", "b_segstr", "b_cnval").agg(F.count_if(F.col("a_o") < F.col("b_o")).alias("a_first"), F.count_if(F.col("a_o") > F.col("b_o")).alias("b_first"), F.count_if(F.col("a_o") == F.col("b_o")).alias("together"))


def likelihood_over_time(occurrences: DataFrame, stats: DataFrame, k: float = 0.0) -> DataFrame:
    """Per event, run and iteration of the run in which it occurs: its weight so far over the
    run's weight so far (null while that is 0)."""
    cost = (F.col("upper_cost") + F.col("lower_cost")) / 2
    runs = stats.select("history_id", run_of(F.col("history_id")).alias("run"), iteration_of(F.col("history_id")).alias("iteration"), F.when(cost != 0, F.exp(-k * cost)).otherwise(0.0).alias("w"))
    so_far = Window.partitionBy("run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("all_w", F.sum("w").over(so_far))
    held = occurrences.select(*KEY, "history_id").distinct().join(runs, "history_id")
    own = Window.partitionBy(*KEY, "run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.select(*KEY, "run", "iteration", F.try_divide(F.sum("w").over(own), F.col("all_w")).alias("likelihood"))


def mixing(occurrences: DataFrame, reference_iteration: int) -> DataFrame:
    """Per history: events of it, of its run's reference iteration, of both, and their Jaccard similarity.

    The reference events are spread to a run's histories by an equality join on the event.
    """
    held = occurrences.select(*KEY, "history_id").distinct().withColumn("run", run_of(F.col("history_id")))
    reference = held.where(iteration_of(F.col("history_id")) == reference_iteration)
    sizes = reference.groupBy("run").agg(F.count(F.lit(1)).alias("n_ref"))
    shared = held.join(reference.select("run", *KEY, F.lit(1).alias("in_ref")), ["run", *KEY], "left")
    per = shared.groupBy("run", "history_id").agg(F.count(F.lit(1)).alias("n_own"), F.count("in_ref").alias("n_both"))
    out = per.join(sizes, "run")
    return out.withColumn("jaccard", F.try_divide(F.col("n_both"), F.col("n_own") + F.col("n_ref") - F.col("n_both")))


def confusion(events: DataFrame) -> DataFrame:
    """Rows (type, predicted, true, explained) counted per type and for ``any``: tp, fp, fn, tn, ex and the F1 score.

    ``explained`` marks missed events that predicted ones add up to: they are counted apart (ex), and for
    the score move from the missed to the found.  Nulls count as false.
    """
    p, t, e = (F.coalesce(c, F.lit(False)) for c in ("predicted", "true", "explained"))
    counts = events.rollup("type").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t & e).alias("ex"))
    found = F.col("tp") + F.col("ex")
    return counts.withColumn("type", F.coalesce("type", F.lit("any"))).withColumn("f1", F.try_divide(2 * found, 2 * found + F.col("fn") - F.col("ex") + F.col("fp")))


def called(events: DataFrame, cutoff: float) -> DataFrame:
    """Add ``predicted``: events above the likelihood ``cutoff`` that also cost something (avecost > 0)."""
    return events.withColumn("predicted", (F.col("likelihood") > cutoff) & (F.col("avecost") > 0))


def optimal_histories(stats: DataFrame) -> DataFrame:
    """The histories of least cost (upper, then lower), numbered from 0."""
    least = stats.agg(F.min(F.struct("upper_cost", "lower_cost")).alias("least")).scalar()
    return numbered(stats.where(F.struct("upper_cost", "lower_cost") == least), ["history_id"])


def length_stats(occurrences: DataFrame) -> DataFrame:
    """Per history: events, longest, and the upper median of ``length``."""
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length DESC)").cast("bigint")
    return occurrences.groupBy("history_id").agg(F.count(F.lit(1)).alias("events"), F.max("length").alias("max_length"), median.alias("median_length"))


def events_per_history(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("history_id").agg(F.countDistinct("ord").alias("orders"), F.countDistinct(*KEY).alias("events"))


def score_pairs(stats: DataFrame, split: int) -> DataFrame:
    """Distinct (upper, lower) costs before and from iteration ``split`` on, with how many histories have them."""
    return stats.withColumn("late", iteration_of(F.col("history_id")) >= split).groupBy("late", "upper_cost", "lower_cost").agg(F.count(F.lit(1)).alias("histories"))


def counts_above(over_time: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Per run and iteration: events whose likelihood so far is above ``cutoff``."""
    return over_time.groupBy("run", "iteration").agg(F.count_if(F.col("likelihood") > cutoff).alias("above"), F.count(F.lit(1)).alias("events"))


def region_stats(history_segments: DataFrame, stats: DataFrame, missing_order: int = 1000) -> DataFrame:
    """Per region and sign (gain or loss): over all histories of ``stats``, weighted by
    exp(-upper cost), the mean count of its segments, mean earliest order and mean total value.

    ``history_segments``: region, history_id, value, ord.  A history without a segment in
    a region counts 0, ``missing_order``, 0; weights and totals are summed once, so no
    region is paired with all histories.
    """
    all_w = stats.agg(F.sum(F.exp(-F.col("upper_cost").cast("double"))).alias("w")).scalar()
    per = history_segments.withColumn("gain", F.col("value") > 0).groupBy("region", "gain", "history_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"), F.sum("value").alias("v"))
    w = per.join(stats.select("history_id", F.exp(-F.col("upper_cost").cast("double")).alias("w")), "history_id")
    sums = w.groupBy("region", "gain").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "o", "v")), F.sum("w").alias("w"))
    return sums.select("region", "gain", (F.col("n") / all_w).alias("mean_count"), ((F.col("o") + missing_order * (all_w - F.col("w"))) / all_w).alias("mean_order"), (F.col("v") / all_w).alias("mean_value"))


def shared_cycles(memberships: DataFrame, top: int = 3) -> DataFrame:
    """Regions by the cycles they share: for each region, the ``top`` others sharing most of
    its cycles.  ``memberships``: region, cycle."""
    m = memberships.distinct()
    size = m.groupBy("region").agg(F.count(F.lit(1)).alias("cycles"))
    other = m.select(F.col("region").alias("other"), "cycle")
    shared = m.join(other, "cycle").where("region <> other").groupBy("region", "other").agg(F.count(F.lit(1)).alias("shared"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("shared"), "other")))
    return ranked.where(F.col("rank") <= top).join(size, "region").withColumn("share", F.col("shared") / F.col("cycles"))


def merge_analyses(rows: DataFrame, name: str, numbers: list[str], partners: str) -> DataFrame:
    """Means of ``numbers`` and the sorted union of ``partners`` per ``name`` over analyses."""
    return rows.groupBy(name).agg(*(F.avg(c).alias(c) for c in numbers), F.array_join(F.sort_array(F.collect_set(partners)), ",").alias(partners))


def allelic_variance(ratios: DataFrame, order: list[str]) -> DataFrame:
    """Population variance of rows (low, high): the first half's low and the second half's
    high values, the halves cut in the rows' order."""
    rows = numbered(ratios, order)
    half = F.when(F.col("number") < (rows.count() + 1) // 2, 1).otherwise(2)
    picked = rows.withColumn("half", half).withColumn("x", F.when(F.col("half") == 1, F.col("low")).otherwise(F.col("high")))
    return picked.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("variance"))


def regression(points: DataFrame, by: str) -> DataFrame:
    """Least-squares line of y on x per ``by``: slope, intercept, r2."""
    return points.groupBy(by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, by: str, score: str, node: str) -> DataFrame:
    """Per ``by`` (a simulation): mean, least and greatest score, distinct nodes and counts of rows (predicted, true)."""
    p, t = F.col("predicted"), F.col("true")
    return rows.groupBy(by).agg(F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.countDistinct(node).alias("nodes"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))


def add_up(counts: DataFrame, sample: str, place: str, value: str) -> DataFrame:
    """Per place the sum over all samples; null where some sample has no such place."""
    samples = counts.agg(F.countDistinct(sample).alias("n")).scalar()
    sums = counts.groupBy(place).agg(F.sum(value).alias("s"), F.countDistinct(sample).alias("n_"))
    return sums.select(place, F.when(F.col("n_") == samples, F.col("s")).alias("total"))


def unmatched_totals(parts: DataFrame, whole: DataFrame, by: str, value: str, total: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose parts do not add up to their total, within ``tolerance``: by, found, total (0 where missing)."""
    sums = parts.groupBy(by).agg(F.sum(value).alias("found")).join(whole.select(by, total), by, "full")
    both = sums.select(by, F.coalesce("found", F.lit(0.0)).alias("found"), F.coalesce(total, F.lit(0.0)).alias(total))
    return both.where(F.abs(F.col("found") - F.col(total)) > tolerance)
