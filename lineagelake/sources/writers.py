"""Writers of the text formats, through Spark's text sink (one line a row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import forest
from ..operators.shared import materialize, shuffle_partitions


def _text(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("NA")) for c in columns))


def write_lines(df: DataFrame, path: str, *columns: Column | str, header: list[str] | None = None) -> None:
    """Tab-separated lines of ``columns``; nulls as NA; a header stands first in each file."""
    if header:
        df.select(*((F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for c, n in zip(columns, header))).write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)
    else:
        df.select(_text(*columns).alias("value")).write.mode("overwrite").text(path)


_TAIL = ["history_id", "net", "cycle", "edge_index", "ord", "upper_cost", "lower_cost", "event_upper", "event_lower", "event_ptr"]


def history_lines(edges: DataFrame) -> DataFrame:
    """Lines of a history file: a segment once with its ends in order, an adjacency in both
    directions; values are the negative of the flow."""
    value = (-F.col("flow")).alias("value")
    tail = [F.col(c) for c in _TAIL]
    segment = _text("chrom", F.least("start", "end"), F.greatest("start", "end"), value, "prevalence", *tail)
    there = _text(F.lit("A"), "chrom", "start", "strand", "chrom2", "end", "strand2", value, "prevalence", *tail)
    back = _text(F.lit("A"), "chrom2", "end", "strand2", "chrom", "start", "strand", value, "prevalence", *tail)
    return edges.select(F.explode(F.when(F.col("is_adj"), F.array(there, back)).otherwise(F.array(segment))).alias("value"))


def coverage_track(cnvs: DataFrame) -> DataFrame:
    """Coverage lines without overlaps: a start that the row before reaches moves behind it."""
    last = F.lag("finish").over(Window.partitionBy("chrom").orderBy("start", "finish"))
    start = F.when(last >= F.col("start"), last + 1).otherwise(F.col("start"))
    return cnvs.select(_text("chrom", start, "finish", "value").alias("value"))


def phase_tracks(segments: DataFrame) -> DataFrame:
    """track (total, majority, minority) and line of segments (chrom, start, finish, phases): sum,
    largest and smallest phase; the last two only where there is more than one."""
    total = F.aggregate("phases", F.lit(0.0), lambda a, x: a + x)
    one = lambda name, v: F.struct(F.lit(name).alias("track"), _text("chrom", "start", "finish", v).alias("value"))
    tracks = F.when(F.size("phases") > 1, F.array(one("total", total), one("majority", F.array_max("phases")), one("minority", F.array_min("phases")))).otherwise(F.array(one("total", total)))
    return segments.where("chrom <> 'None' AND start >= 0").select(F.explode(tracks).alias("t")).select("t.track", "t.value")


def browser_adjacencies(edges: DataFrame, lengths: DataFrame, history_id: int) -> DataFrame:
    """Adjacency lines for a browser: one history, values cut to -1..1 and scaled to 0..1000
    (fractions cut off), positions kept inside the chromosome, each adjacency in one direction."""
    rows = edges.where(F.col("is_adj") & (F.col("history_id") == history_id) & ((F.col("chrom") != F.col("chrom2")) | (F.col("start") <= F.col("end"))))
    rows = rows.join(lengths, "chrom").join(lengths.select(F.col("chrom").alias("chrom2"), F.col("length").alias("length2")), "chrom2")
    score = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value"))) * 500 + 500).cast("int")
    inside = lambda p, n: F.greatest(F.lit(0), F.least(F.col(p), F.col(n)))
    return rows.select(_text("chrom", inside("start", "length"), "strand", "chrom2", inside("end", "length2"), "strand2", score).alias("value"))


def event_lines(summary: DataFrame) -> DataFrame:
    """Lines of scored events."""
    pair = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    return summary.select(_text("event_id", "likelihood", pair("numhists", "num_runs"), pair("preval_mean", "preval_sd"), pair("order_mean", "order_sd"), "cnval", "segstr", "counts").alias("value"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """Lines of history statistics."""
    return stats.select(_text("upper_cost", "lower_cost", "error", "length", "median_length", "max_length").alias("value"))


def event_table_lines(events: DataFrame) -> DataFrame:
    """Lines of the event table: avecost is the mean of upper and lower costs."""
    return events.select(_text("event_id", "event_type", "avecost", "likelihood", "cnval", "length", "numsegs", "preval_mean", "preval_sd", "order_mean", "order_sd", "numhists").alias("value"))


def simulation_lines(events: DataFrame) -> DataFrame:
    """Lines of events held against the truth: true is 1 (found), 0 (wrong) or -1 (missed)."""
    three = lambda *c: F.concat_ws(",", *(F.col(x).cast("string") for x in c))
    return events.select(_text("event_id", "event_type", "avecost", "likelihood", "cnval", "true", "length", three("ref_preval", "preval_mean", "preval_sd"), three("ref_order", "order_mean", "order_sd"), "numhists").alias("value"))


def confusion_lines(confusion: DataFrame, types: tuple[str, ...] = ("any", "amp", "del", "oth", "amdl")) -> DataFrame:
    """One line a measure (TP, FP, FN, TN, EX), a number for each type (0 where there is none), and the F1 score."""
    measures = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(m.upper()).alias("measure"), F.col(m).alias("n")) for k, m in enumerate(("tp", "fp", "fn", "tn", "ex"))))).alias("m")
    wide = confusion.select("type", measures).groupBy("m.place", "m.measure").pivot("type", list(types)).agg(F.sum("m.n")).na.fill(0)
    score = confusion.where("type = 'any'").select(F.lit(5).alias("place"), F.concat(F.lit("F1Score:\t"), F.col("f1").cast("string")).alias("value"))
    return wide.select("place", _text("measure", *types).alias("value")).unionByName(score).orderBy("place").select("value")


def breakpoint_lines(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Places with predicted and true counts of edges and of merged edges (rows chrom, pos, n_pred, n_true of both)."""
    other = merged.select("chrom", "pos", F.col("n_pred").alias("n2"), F.col("n_true").alias("t2"))
    return edges.join(other, ["chrom", "pos"]).select(_text("chrom", "pos", "n_pred", "n_true", "n2", "t2").alias("value"))


def segment_history_lines(profiles: DataFrame) -> DataFrame:
    """One line a profile of a segment: comma lists of copy numbers, prevalences and their deviations, and a label if there is one."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    line = _text("chrom", "start", "finish", "likelihood", "numhists", listed("cnvals"), listed("pvals"), listed("pvals_sd"))
    return profiles.select((F.concat_ws("\t", line, "label") if "label" in profiles.columns else line).alias("value"))


def gene_order_lines(genes: DataFrame, profiles: DataFrame, least: float = 0.5, order: str | None = None) -> DataFrame:
    """Lines of genes (chrom, start, finish, name, seg_id): the total likelihood of the segment's profiles
    (seg_id, likelihood, preval, preval_sd) and the best one's figures where that total exceeds ``least``, else 0.

    Totals are exact to 18 decimals, so they do not depend on how rows are dealt out.  Where they come to just ``least``, doubles are
    added up one by one in the order of the column ``order``, if there is one, as SQL on one thread does.
    """
    exact = F.col("likelihood").try_cast("decimal(38,18)")
    beyond = F.count_if(exact.isNull() & F.col("likelihood").isNotNull())  # no numbers, or too large ones
    total = F.when(beyond == 0, F.try_sum(exact).cast("double")).otherwise(F.sum("likelihood"))
    best = profiles.groupBy("seg_id").agg(total.alias("total"), F.max(F.struct("likelihood", "preval", "preval_sd")).alias("b"))
    if order:
        close = best.where(F.abs(F.col("total") - least) < 1e-9).select("seg_id")
        listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "likelihood")))
        added = profiles.where("likelihood IS NOT NULL").join(close, "seg_id", "left_semi").groupBy("seg_id").agg(F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["likelihood"]).alias("added"))
        best = best.join(added, "seg_id", "left").withColumn("total", F.coalesce("added", "total"))
    rows = genes.join(best, "seg_id", "left")
    sure = F.col("total") > least
    pick = lambda c: F.when(sure, F.col(f"b.{c}")).otherwise(0.0)
    return rows.select(_text("chrom", "start", "finish", "name", F.coalesce("total", F.lit(0.0)), pick("likelihood"), pick("preval"), pick("preval_sd")).alias("value"))


def link_lines(links: DataFrame) -> DataFrame:
    """Lines of links between events."""
    return links.select(_text("node1", "node2", "numhists", "likelihood").alias("value"))


def annotation_lines(annotated: DataFrame) -> DataFrame:
    """Lines of an event and the genes it touches."""
    return annotated.select(_text("event", "genes").alias("value"))


def coverage_graph(segments: DataFrame) -> DataFrame:
    """Coverage lines of segments numbered by chromosome (chrom 1 to 24): 23 is chrX, 24 chrY."""
    name = F.when(F.col("chrom") == 23, "chrX").when(F.col("chrom") == 24, "chrY").otherwise(F.concat(F.lit("chr"), F.col("chrom").cast("string")))
    return segments.select(_text(name, "start", "finish", "mean").alias("value"))


def breakend_lines(breaks: DataFrame, value: float = 1000.0) -> DataFrame:
    """Adjacency lines of breakends, strands turned round, all of one value."""
    turned = lambda c: F.when(F.col(c) == "+", "-").otherwise("+")
    zeros = [F.lit(0)] * 10
    return breaks.select(_text(F.lit("A"), "chrom", "start", turned("strand"), "chrom2", "start2", turned("strand2"), F.lit(value), F.lit(1.0), *zeros).alias("value"))


def region_lines(summary: DataFrame) -> DataFrame:
    """Lines of a table of regions or genes: its columns in order."""
    return summary.select(_text(*summary.columns).alias("value"))


def write_by_place(edges: DataFrame, path: str) -> None:
    """Edges as Parquet by kind and chromosome, sorted by place, so that a region is read by partition and row group."""
    kept = edges.where(F.col("is_adj") | (F.col("end") > F.col("start")))
    kept.repartition("is_adj", "chrom").sortWithinPartitions("start", "end").write.mode("overwrite").partitionBy("is_adj", "chrom").parquet(path)


def read_region(spark: SparkSession, path: str, chrom: str, start: int, finish: int) -> DataFrame:
    """Edges of ``write_by_place`` that touch a region: segments that overlap it, adjacencies that start in it."""
    # kinds and names of partitions are read as text would be
    at = spark.read.parquet(path).withColumn("is_adj", F.col("is_adj").cast("boolean")).withColumn("chrom", F.col("chrom").cast("string")).where(F.col("chrom") == chrom)
    segments = at.where(~F.col("is_adj") & (F.col("start") <= finish) & (F.col("end") >= start))
    return segments.unionByName(at.where(F.col("is_adj") & F.col("start").between(start, finish)))


def newick(tree: DataFrame) -> DataFrame:
    """(root, place, piece): the Newick text of each event tree (event, parent, ratio), cut where events begin and end.

    In the order of ``place`` a tree's pieces are its text, so no task holds a tree or a text.  Children come by
    event; an event is a fork of its children and of what is left of itself (without children, of two such
    leaves), a leaf is named by its event and as long as its ratio, a fork as long as its ratio falls short of its
    parent's (a root's of 1).  An event whose parent is null or unknown is a root; null events have no text, of
    rows that repeat an event one counts; cycles of parents raise.
    """
    rows = materialize(tree.where("event IS NOT NULL").dropDuplicates(["event"]).select("event", "parent", F.col("ratio").cast("double").alias("ratio")), "events")
    up = rows.select(F.col("event").alias("parent"), F.col("ratio").alias("above"))
    held = materialize(rows.join(up, "parent", "left").select("event", F.when(F.col("above").isNotNull(), F.col("parent")).alias("parent"), "ratio", "above"), "events")
    found = forest.ordered_places(held.select(F.col("event").alias("node"), "parent"))
    full = found.join(held.select(F.col("event").alias("node"), "ratio", "above"), "node")
    leaf = F.format_string("%s:%f", F.col("node").cast("string"), "ratio")
    length = F.format_string("%f", F.coalesce("above", F.lit(1.0)) - F.col("ratio"))
    start = F.concat(F.when(F.col("first"), "").otherwise(","), F.lit("("))
    end = F.concat(F.when(F.col("children") > 0, F.concat(F.lit(","), leaf)).otherwise(F.concat(leaf, F.lit(",n"), leaf)), F.lit("):"), length, F.when(F.col("depth") == 0, ";").otherwise(""))
    pieces = F.explode(F.array(F.struct(F.col("enter").alias("place"), start.alias("piece")), F.struct(F.col("leave").alias("place"), end.alias("piece"))))
    return full.select("root", pieces.alias("p")).select("root", "p.place", "p.piece")


def write_newick(tree: DataFrame, path: str) -> None:
    """``newick`` as text files that hold the trees one after the other when read in order of their names: a piece
    a line, as white space between pieces means nothing."""
    newick(tree).repartitionByRange(shuffle_partitions(tree.sparkSession), "root", "place").sortWithinPartitions("root", "place").select(F.col("piece").alias("value")).write.mode("overwrite").text(path)
