"""Interval relations: overlap and as-of joins, merging, splitting, gaps, coverage.

Coordinates are closed ([start, finish], both ends inside) unless a name says ``open``.
Joins are equality joins on (chrom, bin), so they shuffle by key and never nest loops;
running steps go over range parts with carried values (``ordered``), so a chromosome is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Fold, in_parts, running

#: Width of a join bin; intervals a few times this wide are cheapest.
BIN = 10_000


def overlaps_closed(a_start: Column, a_finish: Column, b_start: Column, b_finish: Column) -> Column:
    return (a_start <= b_finish) & (a_finish >= b_start)


def overlaps_open(a_start: Column, a_finish: Column, b_start: Column, b_finish: Column) -> Column:
    return (a_start < b_finish) & (a_finish > b_start)


def point_in_closed(point: Column, start: Column, finish: Column) -> Column:
    return (point >= start) & (point <= finish)


def _floor_bin(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, buffer: int = 0) -> DataFrame:
    """Pairs of rows of one chromosome that overlap (closed), each pair once.

    ``left`` has chrom, start, finish; ``right`` chrom, r_start, r_finish; other columns of
    both are kept (names must differ).  ``buffer`` widens the left intervals.  Rows with a
    null coordinate meet nothing.
    """
    lo, hi = F.col("start") - buffer, F.col("finish") + buffer
    a = left.where("start <= finish").withColumn("bin_", F.explode(F.sequence(_floor_bin(lo, width), _floor_bin(hi, width))))
    b = right.where("r_start <= r_finish").withColumn("bin_", F.explode(F.sequence(_floor_bin(F.col("r_start"), width), _floor_bin(F.col("r_finish"), width))))
    first_shared = F.col("bin_") == F.greatest(_floor_bin(lo, width), _floor_bin(F.col("r_start"), width))
    return a.join(b, ["chrom", "bin_"]).where(first_shared & overlaps_closed(lo, hi, F.col("r_start"), F.col("r_finish"))).drop("bin_")


def points_in_intervals(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Each point (chrom, pos, ...) with the first interval (chrom, r_start, r_finish, ...) that holds it;
    a row that is repeated is answered as often."""
    b = intervals.where("r_start <= r_finish").withColumn("bin_", F.explode(F.sequence(_floor_bin(F.col("r_start"), width), _floor_bin(F.col("r_finish"), width))))
    once = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("n_"))
    hits = once.withColumn("bin_", _floor_bin(F.col("pos"), width)).join(b, ["chrom", "bin_"]).where(point_in_closed(F.col("pos"), F.col("r_start"), F.col("r_finish")))
    payload = [c for c in intervals.columns if c not in ("chrom", "r_start", "r_finish")]
    found = hits.groupBy(*points.columns, "n_").agg(F.min(F.struct("r_start", "r_finish", *payload)).alias("r"))
    return found.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_")))).select(*points.columns, "r.*")


def asof_finish(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each point (chrom, pos, ...) with the first interval of its chromosome whose finish is
    at or after it, if that interval also starts at or before it (else nulls).

    One sort of points and intervals together; no pair is formed.
    """
    payload = [c for c in intervals.columns if c not in ("chrom",)]
    both = points.select("chrom", F.col("pos").alias("at"), F.lit(1).alias("side"), F.struct(*points.columns).alias("p"), F.lit(None).cast(intervals.select(F.struct(*payload)).schema[0].dataType).alias("i"))
    ends = intervals.select("chrom", F.col("r_finish").alias("at"), F.lit(2).alias("side"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("p"), F.struct(*payload).alias("i"))
    # from the right, so that each row only looks at what is already behind it
    by, order = ["chrom"], ["at", "side", "i", "p"]
    found = running(in_parts(both.unionByName(ends), by, order), by, order, {"next_": Fold("last", F.col("i"))}, reverse=True).where("side = 1")
    inside = F.col("next_.r_start") <= F.col("at")
    return found.select("p.*", *(F.when(inside, F.col(f"next_.{c}")).alias(c) for c in payload))


def _islands(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Islands inside groups that a bin bounds."""
    order = Window.partitionBy(*by).orderBy("start", "finish")
    before = F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new_", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    island = F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("island_", island).groupBy(*by, "island_").agg(F.min("start").alias("start"), F.max("finish").alias("finish"), F.sum("n").alias("n")).drop("island_")


def merge_overlapping(intervals: DataFrame, by: tuple[str, ...] = ("chrom",), width: int = 100 * BIN) -> DataFrame:
    """Islands of transitively overlapping (closed) intervals: by, start, finish, n.

    Intervals are merged among those that start in one bin, then the bins' islands among
    themselves, by running values over range parts.
    """
    binned = intervals.select(*by, "start", "finish", F.lit(1).cast("bigint").alias("n"), _floor_bin(F.col("start"), width).alias("bin_"))
    parts = in_parts(_islands(binned, [*by, "bin_"]).drop("bin_"), list(by), ["start", "finish"])
    reach = running(parts, list(by), ["start", "finish"], {"reach_": Fold("max", F.col("finish"), own=False)})
    fresh = F.when(F.col("reach_").isNull() | (F.col("start") > F.col("reach_")), 1).otherwise(0)
    marked = running(reach, list(by), ["start", "finish"], {"island_": Fold("sum", fresh)})
    return marked.groupBy(*by, "island_").agg(F.min("start").alias("start"), F.max("finish").alias("finish"), F.sum("n").alias("n")).drop("island_")


def _beside(intervals: DataFrame, tie: tuple[str, ...], column: str, name: str, following: bool = False) -> DataFrame:
    """Add ``name``: ``column`` of the row before (or after) in its chromosome, by start, finish and ``tie``."""
    by, order = ["chrom"], ["start", "finish", *tie]
    found = running(in_parts(intervals, by, order), by, order, {"beside_": Fold("last", F.struct(column), own=False)}, reverse=following)
    return found.select(*intervals.columns, F.col(f"beside_.{column}").alias(name))


def glue_gaps(intervals: DataFrame, tie: tuple[str, ...] = (), gap: int = 50) -> DataFrame:
    """Move each finish up to the next start when the gap between them is under ``gap``."""
    following = F.col("following_")
    moved = _beside(intervals, tie, "start", "following_", following=True)
    return moved.withColumn("finish", F.when((F.col("finish") > following - gap) & (F.col("finish") < following), following).otherwise(F.col("finish"))).drop("following_")


def gap_fillers(intervals: DataFrame, tie: tuple[str, ...] = (), step: int = 1000) -> DataFrame:
    """Empty bins of ``step`` between neighbours further apart than that: chrom, start, finish."""
    gaps = _beside(intervals, tie, "finish", "last_", following=False).select("chrom", F.col("last_").alias("from_"), F.col("start").alias("to_")).where(F.col("to_") - F.col("from_") > step)
    count = F.ceil((F.col("to_") - F.col("from_")) / F.lit(step)).cast("bigint") - 1
    return gaps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))).select("chrom", (F.col("from_") + F.col("k") * step).alias("start"), (F.col("from_") + (F.col("k") + 1) * step).alias("finish"))


def push_starts(intervals: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Starts moved behind the row before where its finish reaches them (for coverage tracks)."""
    moved = _beside(intervals, tie, "finish", "last_")
    return moved.withColumn("start", F.when(F.col("last_") >= F.col("start"), F.col("last_") + 1).otherwise(F.col("start"))).drop("last_")


def without_overlapping(calls: DataFrame, germline: DataFrame, width: int = BIN) -> DataFrame:
    """The calls that overlap (open) no germline call of their chromosome, as a set."""
    g = germline.select("chrom", F.col("start").alias("g_start"), F.col("finish").alias("g_finish")).distinct()
    g = g.where("g_start <= g_finish").withColumn("bin_", F.explode(F.sequence(_floor_bin(F.col("g_start"), width), _floor_bin(F.col("g_finish"), width))))
    keyed = calls.withColumn("id_", F.struct(*calls.columns))
    hit = keyed.where("start <= finish").withColumn("bin_", F.explode(F.sequence(_floor_bin(F.col("start"), width), _floor_bin(F.col("finish"), width))))
    hit = hit.join(g, ["chrom", "bin_"]).where(overlaps_open(F.col("start"), F.col("finish"), F.col("g_start"), F.col("g_finish"))).select("id_").distinct()
    return keyed.join(hit, "id_", "left_anti").select(*calls.columns)


def on_known_chromosomes(adjacencies: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adjacencies (chrom, chrom2, ...) both of whose ends lie on a chromosome of ``lengths``."""
    names = lengths.select("chrom").distinct()
    return adjacencies.join(names, "chrom", "left_semi").join(names.withColumnRenamed("chrom", "chrom2"), "chrom2", "left_semi").select(*adjacencies.columns)


def elementary(intervals: DataFrame) -> DataFrame:
    """The pieces between neighbouring borders of a chromosome that at least one interval
    covers: chrom, start, finish (half-open), depth.  One sort of borders, no pairs."""
    borders = intervals.where("start < finish").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finish").alias("at"), F.lit(-1).alias("d")))).alias("b"))
    steps = borders.groupBy("chrom", F.col("b.at").alias("start")).agg(F.sum("b.d").alias("d"))
    by, order = ["chrom"], ["start"]
    deep = running(in_parts(steps, by, order), by, order, {"depth": Fold("sum", F.col("d"))})
    deep = running(deep, by, order, {"finish": Fold("last", F.col("start"), own=False)}, reverse=True)
    return deep.where("finish IS NOT NULL AND depth > 0").select("chrom", "start", "finish", "depth")


def border_margins(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """For each segment (chrom, start, finish, seg_id): the last probe before it, its first and
    last probe inside, and the first probe after it (probe: chrom, pos)."""
    inside = points_in_intervals(probes, segments.select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "seg_id")).groupBy("seg_id").agg(F.min("pos").alias("first_in"), F.max("pos").alias("last_in"))
    rows = segments.select("chrom", F.col("start").alias("at"), F.lit(1).alias("side"), "seg_id", F.lit(None).cast("bigint").alias("pos"))
    rows = rows.unionByName(segments.select("chrom", F.col("finish").alias("at"), F.lit(3).alias("side"), "seg_id", F.lit(None).cast("bigint").alias("pos")))
    rows = rows.unionByName(probes.select("chrom", F.col("pos").alias("at"), F.lit(2).alias("side"), F.lit(None).cast(segments.schema["seg_id"].dataType).alias("seg_id"), F.col("pos").cast("bigint").alias("pos")))
    by, order = ["chrom"], ["at", "side", "seg_id"]
    parts = in_parts(rows, by, order)
    before = running(parts, by, order, {"before": Fold("last", F.col("pos"))}).where("side = 1").select("seg_id", "before")
    after = running(parts, by, order, {"after": Fold("last", F.col("pos"))}, reverse=True).where("side = 3").select("seg_id", "after")
    return segments.join(before, "seg_id").join(after, "seg_id").join(inside, "seg_id", "left").select("seg_id", "before", "first_in", "last_in", "after")


def weighted_mean_by_length(segments: DataFrame, value: str = "value", by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Mean of ``value`` weighted by closed length, per ``by``: total length, mean."""
    length = F.col("finish") - F.col("start") + 1
    return segments.groupBy(*by).agg(F.sum(length).alias("length"), (F.sum(F.col(value) * length) / F.sum(length)).alias("mean"))


def normalise_coverage(segments: DataFrame, value: str = "value") -> DataFrame:
    """Add ``normal``: each value over the length-weighted mean of all segments (null if that is 0)."""
    length = F.col("finish") - F.col("start") + 1
    mean = segments.agg((F.sum(F.col(value) * length) / F.sum(length)).alias("m")).scalar()
    return segments.withColumn("normal", F.try_divide(F.col(value), mean))


def value_runs(values: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive distinct integers as ranges: by, first, last, text ("a-b" or "a")."""
    group, order = list(by), [value]
    seen = running(in_parts(values.select(*by, value).distinct(), group, order), group, order, {"k_": Fold("count", F.lit(1))})
    runs = seen.withColumn("g_", F.col(value) - F.col("k_"))
    out = runs.groupBy(*by, "g_").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("g_")
    return out.withColumn("text", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last")))


def close_segments(breakends: DataFrame, lengths: DataFrame) -> DataFrame:
    """The segments of each chromosome between its breakends: chrom, start, finish.

    A breakend's strand tells on which side of it the segment lies; the chromosome's ends
    close the first and the last one.
    """
    cuts = breakends.select("chrom", F.col("start").alias("pos")).distinct()
    seen = running(in_parts(cuts, ["chrom"], ["pos"]), ["chrom"], ["pos"], {"last_": Fold("last", F.col("pos"), own=False)})
    inner = seen.select("chrom", F.coalesce(F.col("last_") + 1, F.lit(0)).alias("start"), F.col("pos").alias("finish"))
    last = cuts.groupBy("chrom").agg(F.max("pos").alias("pos")).join(lengths, "chrom").where("pos < length").select("chrom", (F.col("pos") + 1).alias("start"), F.col("length").alias("finish"))
    return inner.unionByName(last)
