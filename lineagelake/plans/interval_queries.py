"""Queries over intervals and genes, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cycles
from ..operators import events, genehistory, graph, intervals
from ..sources import views
from .event_queries import _r, _with

_SV, _SVG = _with("sv_calls"), _with("sv_calls", "genes")
_TIE = ("l_orderkey", "l_linenumber")


def overlap_join(spark, d):
    g = views.genes(spark, d).select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "gene_id")
    return intervals.overlap_join(views.sv_calls(spark, d), g).select("chrom", "l_orderkey", "l_linenumber", "gene_id")


def overlap_count(spark, d):
    return overlap_join(spark, d).groupBy("chrom").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("gene_id").alias("genes"))


def overlap_buffered(spark, d):
    g = views.genes(spark, d).select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "gene_id")
    return intervals.overlap_join(views.sv_calls(spark, d), g, buffer=500).groupBy("gene_id").agg(F.count(F.lit(1)).alias("calls"))


def point_in_interval(spark, d):
    points = views.sv_calls(spark, d).select("chrom", F.col("start").alias("pos"), "l_orderkey", "l_linenumber")
    g = views.genes(spark, d).select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "gene_id")
    return intervals.points_in_intervals(points, g).select("l_orderkey", "l_linenumber", "gene_id")


def asof_segment(spark, d):
    points = views.sv_calls(spark, d).select("chrom", F.col("start").alias("pos"), "l_orderkey", "l_linenumber")
    g = views.genes(spark, d).select("chrom", F.col("start").alias("r_start"), F.col("finish").alias("r_finish"), "gene_id")
    return intervals.asof_finish(points, g).select("l_orderkey", "l_linenumber", "gene_id")


def merge_intervals(spark, d):
    return intervals.merge_overlapping(views.sv_calls(spark, d))


def glue_gaps(spark, d):
    out = intervals.glue_gaps(views.sv_calls(spark, d), _TIE)
    return out.select("chrom", "start", "finish", "l_orderkey", "l_linenumber")


def gap_fill_bins(spark, d):
    return intervals.gap_fillers(views.sv_calls(spark, d), _TIE)


def nonoverlap_fix(spark, d):
    return intervals.push_starts(views.sv_calls(spark, d), _TIE).select("chrom", "start", "finish", "l_orderkey", "l_linenumber")


def germline_antijoin(spark, d):
    calls = views.sv_calls(spark, d)
    return intervals.without_overlapping(calls.where("flag <> 'A'"), calls.where("flag = 'A'")).select("chrom", "start", "finish", "l_orderkey", "l_linenumber")


def chrom_whitelist(spark, d):
    calls = views.sv_calls(spark, d).withColumn("chrom2", F.concat(F.lit("chr"), (F.col("l_orderkey") % 30 + 1).cast("string")))
    lengths = views.genes(spark, d).where("gene_id % 24 < 12").groupBy("chrom").agg(F.max("finish").alias("length"))
    return intervals.on_known_chromosomes(calls, lengths).groupBy("chrom", "chrom2").agg(F.count(F.lit(1)).alias("n"))


def elementary_intervals(spark, d):
    return intervals.elementary(views.genes(spark, d).withColumn("finish", F.col("finish") + 30_000)).select("chrom", "start", "finish", F.col("depth").cast("bigint").alias("depth"))


def border_margins(spark, d):
    segments = views.genes(spark, d).select("chrom", "start", F.col("finish").alias("finish"), F.col("gene_id").alias("seg_id"))
    probes = views.sv_calls(spark, d).select("chrom", F.col("start").alias("pos")).distinct()
    return intervals.border_margins(segments, probes)


def length_weighted_mean(spark, d):
    return intervals.weighted_mean_by_length(views.sv_calls(spark, d)).select("chrom", "length", _r("mean"))


def coverage_normalise(spark, d):
    out = intervals.normalise_coverage(views.sv_calls(spark, d))
    return out.select("l_orderkey", "l_linenumber", _r("normal"))


def value_ranges(spark, d):
    rows = views.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("g"), F.col("o_custkey").alias("value"))
    return intervals.value_runs(rows, by=("g",)).select("g", "first", "last", "text")


def chromosome_closure(spark, d):
    calls = views.sv_calls(spark, d)
    lengths = views.sv_calls(spark, d).groupBy("chrom").agg((F.max("finish") + 1000).alias("length"))
    return intervals.close_segments(calls, lengths)


def gene_labels(spark, d):
    segments = views.sv_calls(spark, d).select("chrom", "start", "finish", F.concat_ws(":", "l_orderkey", "l_linenumber", "chrom", "start", "finish").alias("seg_id"))
    return genehistory.label_segments(segments, views.genes(spark, d)).select("seg_id", "labels").distinct()


def gene_best_segment(spark, d):
    segments = views.sv_calls(spark, d).select("chrom", "start", "finish", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_id"), (F.col("flag") == "A").alias("is_breakpoint"), F.col("value").alias("likelihood"))
    out = genehistory.best_segment(views.genes(spark, d), segments)
    return out.select("gene_id", "name", "seg_id", "is_breakpoint", _r("likelihood"))


def event_genes(spark, d):
    rows = views.sv_calls(spark, d).select("chrom", "start", "finish", (F.col("l_orderkey") % 500).alias("event"))
    return genehistory.annotate_events(rows, views.genes(spark, d))


def _profiles(spark, d):
    stats = views.hist_stats(spark, d)
    w = F.when(F.col("upper_cost") + F.col("lower_cost") != 0, 1.0).otherwise(0.0)
    rows = views.flow_edges(spark, d).groupBy("segstr", "history_id", "cnval").agg(F.max("preval").alias("preval"))
    values = rows.join(stats.select("history_id", w.alias("weight")), "history_id").withColumnRenamed("segstr", "segment")
    return genehistory.copy_number_profiles(values, events.total_weight(stats))


def cn_profiles(spark, d):
    return _profiles(spark, d).select("segment", "profile", "numhists", _r("likelihood"))


def best_cn_profile(spark, d):
    rounded = _profiles(spark, d).withColumn("likelihood", F.round("likelihood", 9))
    return genehistory.best_profile(rounded).select("segment", "profile", _r("likelihood"), _r("total"))


def event_type_fold(spark, d):
    value = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", value.alias("v")))).alias("o"))
    return rows.select("l_orderkey", cycles.event_type(F.col("o.v")).cast("bigint").alias("event_type"))


def cycle_text(spark, d):
    calls = views.sv_calls(spark, d)
    edge = F.struct((F.col("flag") == "A").alias("is_adj"), "chrom", "start", F.lit("+").alias("strand"), F.col("chrom").alias("chrom2"), F.col("finish").alias("end"), F.lit("-").alias("strand2"), "value")
    rows = calls.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", edge.alias("e")))).alias("o"))
    return rows.select("l_orderkey", cycles.cycle_text(F.col("o.e")).alias("segstr"), cycles.segment_length(F.col("o.e")).alias("length"))


def ordered_ends(spark, d):
    calls = views.sv_calls(spark, d).withColumn("chrom2", F.concat(F.lit("chr"), (F.col("l_orderkey") % 24 + 1).cast("string")))
    out = calls.select("l_orderkey", "l_linenumber", cycles.ordered_ends(F.col("chrom"), F.col("start"), F.col("chrom2"), F.col("finish")).alias("e"))
    return out.select("l_orderkey", "l_linenumber", "e.chrom", "e.start", "e.chrom2", "e.end", "e.swapped")


def flow_offsets(spark, d):
    rows = views.table(spark, d, "lineitem")
    mean, ploidy = F.lit(25.0), F.lit(2.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(cycles.ancestral_offset(F.col("l_quantity"), mean, ploidy) + 1e-10, 6).alias("ancestral"), F.round(cycles.novel_offset(F.col("l_quantity") - 5, mean) + 1e-10, 6).alias("novel"), F.round(cycles.event_ratio(F.col("l_quantity") / 3) + 1e-10, 6).alias("ratio"))


def _bonds(spark, d):
    rows = views.table(spark, d, "orders")
    return rows.select((F.col("o_custkey") * 2).alias("u"), ((F.col("o_custkey") + F.col("o_orderkey") % 4) * 2 + 1).alias("v"), F.round("o_totalprice", 2).alias("flow"))


def group_components(spark, d):
    return graph.components(_bonds(spark, d))


def component_sizes(spark, d):
    return graph.components(_bonds(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def _segments(spark, d):
    return views.table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("node"), (F.col("c_custkey") * 2 + 1).alias("twin"), F.round(F.col("c_acctbal") + 1000, 2).alias("flow"))


def node_imbalance(spark, d):
    out = graph.imbalance(_segments(spark, d), _bonds(spark, d))
    return out.select("node", *(F.round(c, 2).alias(c) for c in ("segment_flow", "bond_flow", "error")))


def bond_scaling(spark, d):
    out = graph.scale_bonds_down(_segments(spark, d), _bonds(spark, d))
    return out.groupBy("u", "v").agg(F.round(F.sum("flow"), 4).alias("flow"))


def net_connections(spark, d):
    return graph.net_connections(_segments(spark, d), graph.components(_bonds(spark, d)))


_BONDS = "bonds AS (SELECT o_custkey * 2 AS u, (o_custkey + o_orderkey % 4) * 2 + 1 AS v, round(o_totalprice, 2) AS flow FROM orders)"
_SEGMENTS = "segments AS (SELECT c_custkey * 2 AS node, c_custkey * 2 + 1 AS twin, round(c_acctbal + 1000, 2) AS flow FROM customer)"
_COMPONENTS = f"""WITH RECURSIVE {_BONDS}, both_ways AS (SELECT DISTINCT u, v FROM bonds UNION SELECT DISTINCT v, u FROM bonds),
    reach(node, label) USING KEY (node) AS (SELECT u, least(u, min(v)) FROM both_ways GROUP BY u UNION
      SELECT b.v, min(r.label) FROM reach r JOIN both_ways b ON r.node = b.u JOIN recurring.reach o ON o.node = b.v WHERE r.label < o.label GROUP BY b.v),
    groups AS (SELECT node, label AS component FROM reach)"""
_IMBALANCE = """imb AS (SELECT node, coalesce(s, 0) AS segment_flow, coalesce(b, 0) AS bond_flow FROM
      (SELECT node, sum(flow) AS s FROM (SELECT node, flow FROM segments UNION ALL SELECT twin, flow FROM segments WHERE twin <> node) t GROUP BY node) x
      FULL JOIN (SELECT node, sum(flow) AS b FROM (SELECT u AS node, flow FROM bonds UNION ALL SELECT v, flow FROM bonds) t GROUP BY node) y USING (node))"""
_PAIRS = "FROM sv_calls c JOIN genes g ON c.chrom = g.chrom AND c.start <= g.finish AND c.finish >= g.start"
_PROFILES = _with("flow_edges", "hist_stats") + """, v AS (SELECT segstr AS segment, history_id, cnval, max(preval) AS preval, any_value(CASE WHEN upper_cost + lower_cost <> 0 THEN 1.0 ELSE 0.0 END) AS w FROM flow_edges JOIN hist_stats USING (history_id) GROUP BY ALL),
    p AS (SELECT segment, history_id, string_agg(cnval::varchar, ',' ORDER BY preval DESC, cnval) AS profile, max(w) AS w FROM v WHERE cnval <> 0 GROUP BY ALL),
    prof AS (SELECT segment, profile, count(*) AS numhists, sum(w) / (SELECT count(*) FROM hist_stats WHERE upper_cost > 0 AND upper_cost + lower_cost <> 0) AS likelihood FROM p GROUP BY ALL)"""

QUERIES = {
    "overlap_join": (overlap_join, _SVG + "SELECT c.chrom, l_orderkey, l_linenumber, gene_id " + _PAIRS),
    "overlap_count": (overlap_count, _SVG + "SELECT c.chrom, count(*) AS pairs, count(DISTINCT gene_id) AS genes " + _PAIRS + " GROUP BY c.chrom"),
    "overlap_buffered": (overlap_buffered, _SVG + "SELECT gene_id, count(*) AS calls FROM sv_calls c JOIN genes g ON c.chrom = g.chrom AND c.start - 500 <= g.finish AND c.finish + 500 >= g.start GROUP BY gene_id"),
    "point_in_interval": (point_in_interval, _SVG + "SELECT l_orderkey, l_linenumber, gene_id FROM (SELECT l_orderkey, l_linenumber, gene_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, c.start, c.chrom ORDER BY g.start, g.finish, gene_id) AS n FROM sv_calls c JOIN genes g ON c.chrom = g.chrom AND c.start BETWEEN g.start AND g.finish) t WHERE n = 1"),
    "asof_segment": (asof_segment, _SVG + """SELECT c.l_orderkey, c.l_linenumber, CASE WHEN b.start <= c.start THEN b.gene_id END AS gene_id FROM sv_calls c
        ASOF LEFT JOIN (SELECT * FROM genes QUALIFY row_number() OVER (PARTITION BY chrom, finish ORDER BY start, gene_id) = 1) b ON c.chrom = b.chrom AND c.start <= b.finish"""),
    "merge_intervals": (merge_intervals, _SV + """, m AS (SELECT *, coalesce(start > max(finish) OVER (PARTITION BY chrom ORDER BY start, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::int AS fresh FROM sv_calls),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, finish, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chrom, min(start) AS start, max(finish) AS finish, count(*) AS n FROM i GROUP BY chrom, island"""),
    "glue_gaps": (glue_gaps, _SV + """SELECT chrom, start, CASE WHEN finish > nxt - 50 AND finish < nxt THEN nxt ELSE finish END AS finish, l_orderkey, l_linenumber FROM (SELECT *, lead(start) OVER (PARTITION BY chrom ORDER BY start, finish, l_orderkey, l_linenumber) AS nxt FROM sv_calls) t"""),
    "gap_fill_bins": (gap_fill_bins, _SV + """, g AS (SELECT chrom, lag(finish) OVER (PARTITION BY chrom ORDER BY start, finish, l_orderkey, l_linenumber) AS a, start AS z FROM sv_calls)
        SELECT chrom, a + k * 1000 AS start, a + (k + 1) * 1000 AS finish FROM (SELECT chrom, a, unnest(range(0, ((z - a + 999) // 1000 - 1)::bigint)) AS k FROM g WHERE z - a > 1000) t"""),
    "nonoverlap_fix": (nonoverlap_fix, _SV + "SELECT chrom, CASE WHEN last >= start THEN last + 1 ELSE start END AS start, finish, l_orderkey, l_linenumber FROM (SELECT *, lag(finish) OVER (PARTITION BY chrom ORDER BY start, finish, l_orderkey, l_linenumber) AS last FROM sv_calls) t"),
    "germline_antijoin": (germline_antijoin, _SV + "SELECT chrom, start, finish, l_orderkey, l_linenumber FROM sv_calls c WHERE flag <> 'A' AND NOT EXISTS (SELECT 1 FROM sv_calls g WHERE g.flag = 'A' AND g.chrom = c.chrom AND c.start < g.finish AND c.finish > g.start)"),
    "chrom_whitelist": (chrom_whitelist, _SVG + ", w AS (SELECT DISTINCT chrom FROM genes WHERE gene_id % 24 < 12) SELECT chrom, concat('chr', l_orderkey % 30 + 1) AS chrom2, count(*) AS n FROM sv_calls WHERE chrom IN (SELECT chrom FROM w) AND concat('chr', l_orderkey % 30 + 1) IN (SELECT chrom FROM w) GROUP BY 1, 2"),
    "elementary_intervals": (elementary_intervals, _with("genes") + """, b AS (SELECT chrom, start AS p, 1 AS d FROM genes UNION ALL SELECT chrom, finish + 30000, -1 FROM genes), s AS (SELECT chrom, p, sum(d) AS d FROM b GROUP BY ALL)
        SELECT chrom, p AS start, finish, depth::bigint AS depth FROM (SELECT chrom, p, lead(p) OVER w AS finish, sum(d) OVER (PARTITION BY chrom ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth FROM s WINDOW w AS (PARTITION BY chrom ORDER BY p)) t WHERE finish IS NOT NULL AND depth > 0"""),
    "border_margins": (border_margins, _SVG + """, seg AS (SELECT chrom, start, finish, gene_id AS seg_id FROM genes), p AS (SELECT DISTINCT chrom, start AS pos FROM sv_calls)
        SELECT seg_id, max(pos) FILTER (pos < start) AS before, min(pos) FILTER (pos BETWEEN start AND finish) AS first_in, max(pos) FILTER (pos BETWEEN start AND finish) AS last_in, min(pos) FILTER (pos > finish) AS after FROM seg LEFT JOIN p USING (chrom) GROUP BY seg_id"""),
    "length_weighted_mean": (length_weighted_mean, _SV + "SELECT chrom, sum(finish - start + 1)::bigint AS length, round(sum(value * (finish - start + 1)) / sum(finish - start + 1) + 1e-10, 6) AS mean FROM sv_calls GROUP BY chrom"),
    "coverage_normalise": (coverage_normalise, _SV + ", m AS (SELECT sum(value * (finish - start + 1)) / sum(finish - start + 1) AS m FROM sv_calls) SELECT l_orderkey, l_linenumber, round(value / m + 1e-10, 6) AS normal FROM sv_calls, m"),
    "value_ranges": (value_ranges, """SELECT g, min(v) AS first, max(v) AS last, CASE WHEN min(v) = max(v) THEN min(v)::varchar ELSE concat(min(v), '-', max(v)) END AS text FROM (SELECT g, v, v - row_number() OVER (PARTITION BY g ORDER BY v) AS k FROM (SELECT DISTINCT o_custkey % 5 AS g, o_custkey AS v FROM orders) t) u GROUP BY g, k"""),
    "chromosome_closure": (chromosome_closure, _SV + """, cuts AS (SELECT DISTINCT chrom, start AS pos FROM sv_calls), len AS (SELECT chrom, max(finish) + 1000 AS length FROM sv_calls GROUP BY chrom)
        SELECT chrom, coalesce(lag(pos) OVER (PARTITION BY chrom ORDER BY pos) + 1, 0) AS start, pos AS finish FROM cuts UNION ALL SELECT chrom, max(pos) + 1, any_value(length) FROM cuts JOIN len USING (chrom) GROUP BY chrom HAVING max(pos) < any_value(length)"""),
    "gene_labels": (gene_labels, _SVG + "SELECT concat(l_orderkey, ':', l_linenumber, ':', c.chrom, ':', c.start, ':', c.finish) AS seg_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS labels FROM sv_calls c LEFT JOIN genes g ON c.chrom = g.chrom AND c.start <= g.finish AND c.finish >= g.start GROUP BY 1"),
    "gene_best_segment": (gene_best_segment, _SVG + "SELECT gene_id, name, seg_id, is_breakpoint, round(likelihood + 1e-10, 6) AS likelihood FROM (SELECT gene_id, name, l_orderkey * 10 + l_linenumber AS seg_id, flag = 'A' AS is_breakpoint, value AS likelihood " + _PAIRS + ") t QUALIFY row_number() OVER (PARTITION BY gene_id, name ORDER BY is_breakpoint, likelihood DESC, seg_id) = 1"),
    "event_genes": (event_genes, _SVG + "SELECT l_orderkey % 500 AS event, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), 'None') AS genes FROM sv_calls c LEFT JOIN genes g ON c.chrom = g.chrom AND c.start <= g.finish AND c.finish >= g.start GROUP BY 1"),
    "cn_profiles": (cn_profiles, _PROFILES + " SELECT segment, profile, numhists, round(likelihood + 1e-10, 6) AS likelihood FROM prof"),
    "best_cn_profile": (best_cn_profile, _PROFILES + " SELECT segment, profile, round(likelihood + 1e-10, 6) AS likelihood, round(total + 1e-10, 6) AS total FROM (SELECT *, sum(likelihood) OVER (PARTITION BY segment) AS total, row_number() OVER (PARTITION BY segment ORDER BY round(likelihood, 9) DESC, profile) AS n FROM prof) t WHERE n = 1"),
    "event_type_fold": (event_type_fold, """SELECT l_orderkey, (CASE t WHEN 0 THEN 3 ELSE t END)::bigint AS event_type FROM (SELECT l_orderkey, list_reduce(list_prepend(0, list(CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END)),
        lambda t, c: CASE WHEN c < 0 AND t <> 2 THEN 1 WHEN c > 0 AND t <> 1 THEN 2 ELSE 4 END) AS t FROM lineitem GROUP BY l_orderkey) x"""),
    "cycle_text": (cycle_text, _SV + """SELECT l_orderkey, string_agg(CASE WHEN flag = 'A' THEN concat(chrom, ':', start, '(+)-', chrom, ':', finish, '(-)') ELSE concat(chrom, ':', start, '-', finish) END, ',' ORDER BY l_linenumber, flag = 'A', chrom, start, finish) AS segstr,
        coalesce(sum(abs(finish - start) + 1) FILTER (flag <> 'A'), 0)::bigint AS length FROM sv_calls GROUP BY l_orderkey"""),
    "ordered_ends": (ordered_ends, _SV + """, a AS (SELECT *, concat('chr', l_orderkey % 24 + 1) AS chrom2 FROM sv_calls), s AS (SELECT *, chrom > chrom2 OR (chrom = chrom2 AND start > finish) AS swapped FROM a)
        SELECT l_orderkey, l_linenumber, CASE WHEN swapped THEN chrom2 ELSE chrom END AS chrom, CASE WHEN swapped THEN finish ELSE start END AS start, CASE WHEN swapped THEN chrom ELSE chrom2 END AS chrom2, CASE WHEN swapped THEN start ELSE finish END AS "end", swapped FROM s"""),
    "flow_offsets": (flow_offsets, """SELECT l_orderkey, l_linenumber, round((l_quantity / 25.0 * 2 - 1) * 2 / 2 + 1e-10, 6) AS ancestral, round(greatest(0, (l_quantity - 5) / 25.0 * 2) + 1e-10, 6) AS novel, round((l_quantity / 3) / ceil(l_quantity / 3) + 1e-10, 6) AS ratio FROM lineitem"""),
    "group_components": (group_components, _COMPONENTS + " SELECT node, component FROM groups"),
    "component_sizes": (component_sizes, _COMPONENTS + " SELECT component, count(*) AS nodes FROM groups GROUP BY component"),
    "node_imbalance": (node_imbalance, f"WITH {_BONDS}, {_SEGMENTS}, {_IMBALANCE} SELECT node, round(segment_flow, 2) AS segment_flow, round(bond_flow, 2) AS bond_flow, round(abs(segment_flow - bond_flow), 2) AS error FROM imb"),
    "bond_scaling": (bond_scaling, f"""WITH {_BONDS}, {_SEGMENTS}, {_IMBALANCE}, f AS (SELECT node, CASE WHEN bond_flow > segment_flow THEN segment_flow / bond_flow ELSE 1 END AS f FROM imb)
        SELECT u, v, round(sum(flow * least(a.f, b.f)), 4) AS flow FROM bonds JOIN f a ON u = a.node JOIN f b ON v = b.node GROUP BY u, v"""),
    "net_connections": (net_connections, _COMPONENTS + f", {_SEGMENTS} SELECT least(x.component, y.component) AS a, greatest(x.component, y.component) AS b, count(*) AS blocks FROM segments s JOIN groups x ON s.node = x.node JOIN groups y ON s.twin = y.node GROUP BY 1, 2"),
}
