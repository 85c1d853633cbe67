"""Queries of streams, block sequences, order-dependent folds and iterative estimates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.shared import shared_dir
from ..sources import views
from ..streaming import histories
from .event_queries import _with


def stream_event_windows(spark, d):
    out = histories.catch_up(histories.tumbling(histories.stream_of(spark, f"{d.rstrip('/')}/events.parquet")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round(F.col("total") + 1e-10, 4).alias("total"))


def stream_run_occurrences(spark, d):
    rows = histories.stream_of(spark, f"{d.rstrip('/')}/lineitem.parquet")
    cnval = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    edges = rows.select(((F.col("l_suppkey") % 4) * views.RUN_STRIDE + F.col("l_orderkey") % 25).alias("history_id"), F.concat(F.lit("seg"), (F.col("l_partkey") % 300).cast("string")).alias("segstr"), cnval.alias("cnval"), F.col("l_discount").cast("double").alias("preval"))
    return histories.catch_up(histories.occurrences_per_run(edges))


def stream_merged_events(spark, d):
    """Events merged over a stream of occurrences, read from the table that its batches have added to."""
    rows = histories.stream_of(spark, f"{d.rstrip('/')}/lineitem.parquet")
    cnval = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    edges = rows.select(((F.col("l_suppkey") % 4) * views.RUN_STRIDE + F.col("l_orderkey") % 25).alias("history_id"), F.concat(F.lit("seg"), (F.col("l_partkey") % 300).cast("string")).alias("segstr"), cnval.alias("cnval"), F.col("l_discount").cast("double").alias("preval"))
    path = f"{shared_dir(spark)}/rolled-{uuid.uuid4().hex}"
    histories.roll(histories.merged_events(edges), path)
    return histories.rolled(spark, path, ["segstr", "cnval"]).withColumn("sum_preval", F.round(F.col("sum_preval") + 1e-10, 4))


def _genomes(spark, d):
    """Each order as a circular genome: its parts in line order, returned ones reversed."""
    block = F.when(F.col("l_returnflag") == "R", -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sim_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b")))).alias("o"))
    return rows.select("sim_id", F.col("o.b").alias("genome"))


def genome_bonds(spark, d):
    return sampling.adjacency_counts(_genomes(spark, d))


def genome_copies(spark, d):
    return sampling.block_copies(_genomes(spark, d)).groupBy("sim_id").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("blocks"))


def em_clock(spark, d):
    counts = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("count"))
    found, _ = sampling.poisson_mixture(counts)
    return spark.createDataFrame([(k, round(w, 4), round(m, 4)) for k, (w, m) in enumerate(found)], "part int, weight double, mean double")


def partial_order_depth(spark, d):
    rows = views.table(spark, d, "orders").select(F.col("o_custkey").alias("before"), (F.col("o_custkey") * 2 + F.col("o_orderkey") % 7 + 1).alias("after"))
    return sampling.topological_depth(rows).select("element", F.col("depth").cast("bigint").alias("depth"))


def absorbed_segments(spark, d):
    rows = views.sv_calls(spark, d).groupBy("chrom", "start").agg(F.max("finish").alias("finish"), F.count(F.lit(1)).alias("c"), F.avg("value").alias("mean"))
    out = sampling.absorb_small(rows.select(F.lit("s").alias("sample"), "chrom", "start", "finish", (F.col("start") / 10 % 9).cast("bigint").alias("m0"), "mean").withColumn("num_marks", F.col("m0") + 1))
    return out.select("sample", "chrom", "start", "finish", "num_marks", F.round(F.col("mean") + 1e-10, 5).alias("mean"))


def germline_fold(spark, d):
    calls = views.sv_calls(spark, d).select("chrom", "start", "finish", (F.col("flag") == "A").alias("germline"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("call_id"))
    return sampling.germline_fold(calls)


_GENOMES = "WITH genomes AS (SELECT l_orderkey AS sim_id, list(CASE WHEN l_returnflag = 'R' THEN -l_partkey ELSE l_partkey END ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_partkey ELSE l_partkey END) AS g FROM lineitem GROUP BY l_orderkey)"

QUERIES = {
    "stream_event_windows": (stream_event_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value) + 1e-10, 4) AS total FROM events GROUP BY 1, 2"),
    "stream_run_occurrences": (stream_run_occurrences, _with("flow_edges") + "SELECT history_id // 10000 AS run, segstr, cnval, count(*) AS n, max(preval) AS max_preval FROM flow_edges GROUP BY ALL"),
    "stream_merged_events": (stream_merged_events, _with("flow_edges") + "SELECT segstr, cnval, count(*) AS n, min(history_id) AS first_history, max(history_id) AS last_history, round(sum(preval) + 1e-10, 4) AS sum_preval, max(preval) AS max_preval FROM flow_edges GROUP BY ALL"),
    "genome_bonds": (genome_bonds, _GENOMES + """, p AS (SELECT sim_id, g[i] AS x, -g[i % len(g) + 1] AS y FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM genomes) t)
        SELECT sim_id, least(x, y) AS "left", greatest(x, y) AS "right", count(*) AS n FROM p GROUP BY ALL"""),
    "genome_copies": (genome_copies, _GENOMES + " SELECT sim_id, max(n) AS most, count(*) AS blocks FROM (SELECT sim_id, abs(b) AS block, count(*) AS n FROM (SELECT sim_id, unnest(g) AS b FROM genomes) t GROUP BY ALL) u GROUP BY sim_id"),
    "em_clock": (em_clock, None),
    "partial_order_depth": (partial_order_depth, """WITH RECURSIVE c AS (SELECT DISTINCT o_custkey AS a, o_custkey * 2 + o_orderkey % 7 + 1 AS b FROM orders),
        r(element, depth) AS (SELECT a, 0 FROM c UNION SELECT b, depth + 1 FROM r JOIN c ON r.element = c.a), e AS (SELECT a AS element FROM c UNION SELECT b FROM c)
        SELECT element, coalesce(max(depth), 0)::bigint AS depth FROM e LEFT JOIN r USING (element) GROUP BY element"""),
    "absorbed_segments": (absorbed_segments, None),
    "germline_fold": (germline_fold, None),
}
