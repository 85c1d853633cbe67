"""Genes and segment histories: labels, best segments, copy-number profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


def label_segments(segments: DataFrame, genes: DataFrame, width: int = 10_000) -> DataFrame:
    """Each segment (chrom, start, finish, seg_id) with the sorted distinct names of the genes it
    overlaps, joined by commas; empty where there are none."""
    g = genes.select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "name")
    named = overlap_join(segments, g, width).groupBy("seg_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("labels"))
    return segments.join(named, "seg_id", "left").withColumn("labels", F.coalesce("labels", F.lit("")))


def best_segment(genes: DataFrame, segments: DataFrame, width: int = 10_000) -> DataFrame:
    """Per gene the overlapping segment (seg_id, is_breakpoint, likelihood) to represent it: not
    a breakpoint if there is one, then the most likely, then the least seg_id."""
    s = segments.select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "seg_id", "is_breakpoint", "likelihood")
    pairs = overlap_join(genes, s, width)
    rank = F.struct((~F.col("is_breakpoint")).alias("plain"), "likelihood", (-F.col("seg_id")).alias("neg"))
    best = pairs.groupBy("gene_id", "name").agg(F.max(rank).alias("b"))
    return best.select("gene_id", "name", (-F.col("b.neg")).alias("seg_id"), (~F.col("b.plain")).alias("is_breakpoint"), F.col("b.likelihood").alias("likelihood"))


def annotate_events(event_segments: DataFrame, genes: DataFrame, width: int = 10_000) -> DataFrame:
    """Per event (rows chrom, start, finish, event): distinct genes it touches, "None" if none."""
    g = genes.select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "name")
    hit = overlap_join(event_segments, g, width).groupBy("event").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("genes"))
    return event_segments.select("event").distinct().join(hit, "event", "left").withColumn("genes", F.coalesce("genes", F.lit("None")))


def copy_number_profiles(values: DataFrame, total: Column, by: str = "segment") -> DataFrame:
    """Histories of each segment grouped by their profile: the copy-number changes in order of
    falling prevalence, zeros left out.  values: ``by``, history_id, cnval, preval, weight;
    ``total``: the weight of all histories (``events.total_weight``)."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("preval")).alias("p"), "cnval")))
    per = values.where("cnval <> 0").groupBy(by, "history_id").agg(order.alias("o"), F.max("weight").alias("w"))
    profile = F.array_join(F.transform("o", lambda x: x.cnval.cast("string")), ",")
    return per.groupBy(by, profile.alias("profile")).agg(F.count(F.lit(1)).alias("numhists"), F.try_divide(F.sum("w"), total).alias("likelihood"))


def best_profile(profiles: DataFrame, by: str = "segment") -> DataFrame:
    """Per segment: its most likely profile (ties: the least profile text) and the likelihood of all."""
    order = Window.partitionBy(by).orderBy(F.desc("likelihood"), "profile")
    all_l = F.sum("likelihood").over(Window.partitionBy(by))
    return profiles.withColumn("total", all_l).withColumn("n_", F.row_number().over(order)).where("n_ = 1").select(by, "profile", "likelihood", "total")
