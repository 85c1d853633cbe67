"""Queries over cycles, and through the text formats: written, read back, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cycles
from ..operators import diagnostics, events
from ..operators.shared import free_shuffles, shared_dir
from ..sources import readers, views, writers
from . import event_queries
from .event_queries import _r, _with

_SV = _with("sv_calls")


def _path(spark, name):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def _through(spark, lines, reader, name="lines"):
    """What ``reader`` gives of ``lines`` (column value) written as text."""
    path = _path(spark, name)
    # history files are gzip as a rule
    lines.write.text(path, compression="gzip" if name.startswith("HISTORIES") else "none")
    free_shuffles(spark)
    return reader(spark, path)


def _columns(*names):
    """A reader of tab-separated lines: ``names`` are "column type"."""
    def read(spark, path):
        return spark.read.schema(", ".join(names)).option("sep", "\t").option("quote", "").csv(path)

    return read


def _walks(spark, d):
    """Each order as a closed walk over the distinct starts of its lines: edges from point to point."""
    points = views.sv_calls(spark, d).groupBy("l_orderkey", "chrom", "start").agg(F.min("l_linenumber").alias("n"))
    walks = points.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "chrom", "start"))).alias("p"))
    follow = lambda x, i: F.get(F.col("p"), F.pmod(i + 1, F.size("p")))
    edge = lambda x, i: F.struct(F.lit(True).alias("is_adj"), x.chrom.alias("chrom"), x.start.alias("start"), F.lit("+").alias("strand"), follow(x, i).chrom.alias("chrom2"), follow(x, i).start.alias("end"), F.lit("-").alias("strand2"), F.lit(1.0).alias("value"))
    return walks.select("l_orderkey", F.transform("p", edge).alias("edges"))


def canonical_cycles(spark, d):
    return _walks(spark, d).select("l_orderkey", cycles.cycle_text(cycles.canonical(F.col("edges"))).alias("segstr"))


def figure_eights(spark, d):
    """Each order as a walk that comes back to few places, cut into simple cycles."""
    calls = views.sv_calls(spark, d).select("l_orderkey", "l_linenumber", F.col("start") % 30, "finish", "value").toDF("k", "n", "start", "end", "value")
    edge = F.struct((F.col("n") % 2 == 0).alias("is_adj"), F.lit("chr1").alias("chrom"), "start", F.lit("+").alias("strand"), F.lit("chr1").alias("chrom2"), "end", F.lit("-").alias("strand2"), "value")
    rows = calls.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", edge.alias("e")))).alias("o")).select("k", F.col("o.e").alias("edges"))
    parts = rows.select("k", F.size("edges").alias("edges"), cycles.split_figure_eights(F.col("edges")).alias("c"))
    return parts.select(F.col("k").alias("l_orderkey"), F.size("c").alias("cycles"), F.array_join(F.transform("c", lambda x: F.size(x).cast("string")), ",").alias("sizes"), "edges")


def merged_segments(spark, d):
    """Each order's lines as segments that neighbouring positions join: one segment each."""
    calls = views.sv_calls(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    at = F.col("l_linenumber").cast("bigint") * 100
    made = lambda adj, a, z: F.struct(F.lit(adj).alias("is_adj"), F.lit("c").alias("chrom"), a.alias("start"), F.lit("+").alias("strand"), F.lit("c").alias("chrom2"), z.alias("end"), F.lit("-").alias("strand2"), F.lit(1.0).alias("value"))
    pair = F.array(made(False, at, at + 99), made(True, at + 99, at + 100))
    rows = calls.groupBy("l_orderkey").agg(F.flatten(F.array_sort(F.collect_list(F.struct("l_linenumber", pair.alias("p")))).getField("p")).alias("edges"))
    done = rows.select("l_orderkey", cycles.merge_adjacent(F.col("edges")).alias("e"))
    return done.select("l_orderkey", F.size(F.filter("e", lambda x: ~x.is_adj)).alias("segments"), F.expr("aggregate(filter(e, x -> NOT x.is_adj), 0L, (s, x) -> s + x.end - x.start + 1)").alias("bases"))


def edge_relations(spark, d):
    """Neighbouring edges of each order's walk: how they meet."""
    rows = _walks(spark, d).select("l_orderkey", F.posexplode("edges").alias("i", "a"), "edges").select("l_orderkey", "a", F.get("edges", F.pmod(F.col("i") + 1, F.size("edges"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("l_orderkey").agg(F.count_if(cycles.connected(a, b)).alias("connected"), F.count_if(cycles.crosses(a, b)).alias("crossing"), F.count_if(cycles.same_ends(a, b)).alias("same"), F.count_if(cycles.same_place(a, b)).alias("equal"), F.count_if(cycles.is_breakpoint(a)).alias("breakpoints"))


def edge_scores(spark, d):
    """Edges of events: every order an event of its lines, scored by the histories that hold the edge."""
    edges = views.flow_edges(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.struct("segstr", "history_id")).alias("segs")).select(F.explode("segs").alias("s")).select("s.segstr", "s.history_id", F.lit(0).alias("cnval"))
    out = events.likelihood(edges, views.hist_stats(spark, d))
    return out.select("segstr", "numhists", _r("likelihood"))


def order_correction(spark, d):
    """Mean and deviation of the events' rank fractions in place of their orders."""
    ranked = diagnostics.rank_fractions(views.flow_edges(spark, d), event_queries._TIE).withColumn("ord", F.col("fraction"))
    out = events.timing(ranked, views.hist_stats(spark, d))
    return out.select("segstr", "cnval", _r("order_mean"), _r("order_sd"))


def accuracy_by_simulation(spark, d):
    """Per simulation: scores, node counts and how its events were found."""
    rows = views.flow_edges(spark, d).select((F.col("l_orderkey") % 50).alias("sim"), "segstr", "preval", (F.col("cnval") > 0).alias("predicted"), (F.col("ord") > 3).alias("true"))
    return diagnostics.accuracy(rows, "sim", "preval", "segstr").select("sim", _r("mean_score"), "min_score", "max_score", "nodes", "tp", "fp", "fn", "tn")


def combined_counts(spark, d):
    """Counts of samples of unequal length added up place by place: null where one has ended."""
    rows = views.flow_edges(spark, d).groupBy((F.col("l_orderkey") % 5).alias("sample"), (F.col("history_id") % 10000 * 100 + F.col("l_orderkey") % 7).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return diagnostics.add_up(rows, "sample", "place", "n")


def flow_totals(spark, d):
    """Edges whose events' flows do not add up to their own."""
    parts = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge"), F.round("l_extendedprice", 2).alias("flow"))
    whole = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.round("o_totalprice", 2).alias("total"))
    return diagnostics.unmatched_totals(parts, whole, "edge", "flow", "total", 100_000).select("edge", F.round("found", 2).alias("found"), "total")


def file_bed(spark, d):
    lines = views.genes(spark, d).select(F.concat_ws("\t", "chrom", "start", "finish", "name", F.lit("+"), F.lit("1.5")).alias("value"))
    return _through(spark, lines, readers.bed)


def file_regions(spark, d):
    lines = writers.region_lines(views.genes(spark, d).select(F.col("gene_id").alias("label"), "chrom", F.lit("+"), "start", "finish"))
    return _through(spark, lines, readers.regions)


def file_lengths(spark, d):
    lines = views.sv_calls(spark, d).groupBy("chrom").agg(F.max("finish").alias("length")).select(F.concat_ws(" ", F.regexp_replace("chrom", "chr", ""), "length").alias("value"))
    return _through(spark, lines, readers.chrom_lengths)


def file_histories(spark, d):
    """Calls as edges of sampled histories; an adjacency comes back once for each direction."""
    calls = views.sv_calls(spark, d)
    zero = [F.lit(0).alias(c) for c in ("net", "cycle", "upper_cost", "lower_cost", "event_upper", "event_lower")]
    edges = calls.select((F.col("flag") == "A").alias("is_adj"), "chrom", "start", F.lit("+").alias("strand"), F.col("chrom").alias("chrom2"), F.col("finish").alias("end"), F.lit("-").alias("strand2"), F.lit(-1.0).alias("flow"), F.lit(0.5).alias("prevalence"), (F.col("l_orderkey") % 25).alias("history_id"), F.col("l_linenumber").alias("edge_index"), F.col("l_orderkey").alias("ord"), F.lit("p").alias("event_ptr"), *zero)
    back = _through(spark, writers.history_lines(edges), readers.histories, "HISTORIES_3")
    return back.groupBy("run", "is_adj", "chrom", "history_id", "cnval").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("edge_index").alias("places"))


def file_events(spark, d):
    summary = events.summary(views.flow_edges(spark, d), views.hist_stats(spark, d)).withColumnRenamed("num_runs", "num_runs")
    back = _through(spark, writers.event_lines(summary), readers.events_text)
    return back.select("event_id", "segstr", F.col("cnval").cast("bigint").alias("cnval"), "numhists", "numsims", _r("likelihood"), _r("preval_mean"), _r("order_sd"), "run_counts")


def file_segment_histories(spark, d):
    rows = views.sv_calls(spark, d).select("chrom", "start", "finish", F.col("value").alias("likelihood"), F.col("l_linenumber").alias("numhists"), F.array(F.lit(1.0), F.lit(-2.0)).alias("cnvals"), F.array("value", F.lit(0.5)).alias("pvals"), F.array(F.lit(0.0), F.lit(0.25)).alias("pvals_sd"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("label"))
    back = _through(spark, writers.segment_history_lines(rows), readers.segment_histories)
    return back.select("chrom", "start", "finish", "likelihood", "numhists", F.expr("aggregate(cnvals, 0D, (a, x) -> a + x)").alias("cn_sum"), F.round(F.expr("aggregate(pvals, 0D, (a, x) -> a + x)"), 6).alias("p_sum"), F.get("pvals_sd", F.lit(1)).alias("sd"), "label")


def file_confusion(spark, d):
    lines = writers.confusion_lines(event_queries.confusion_matrix(spark, d)).where("value NOT LIKE 'F1%'")
    return _through(spark, lines, _columns("measure string", '"any" bigint'.replace('"', "`"), "amp bigint", "del bigint", "oth bigint", "amdl bigint"))


def file_breakpoints(spark, d):
    calls = views.sv_calls(spark, d)
    ends = calls.select("chrom", F.explode(F.array("start", "finish")).alias("pos"), F.concat(F.lit("e"), (F.col("l_orderkey") % 50).cast("string")).alias("event"), (F.col("l_orderkey") % 7).alias("history_id"))
    merged = ends.where("event < 'e3'")
    lines = writers.breakpoint_lines(events.breakpoint_counts(ends, 0), events.breakpoint_counts(merged, 0))
    return _through(spark, lines, _columns("chrom string", "pos bigint", "n_pred bigint", "n_true bigint", "n2 bigint", "t2 bigint"))


def file_links(spark, d):
    links = events.links(views.flow_edges(spark, d))
    named = links.select(F.concat_ws("/", "segstr", "cnval").alias("node1"), F.concat_ws("/", "next_segstr", "next_cnval").alias("node2"), "numhists", F.round(F.col("numhists") / 100, 4).alias("likelihood"))
    return _through(spark, writers.link_lines(named), _columns("node1 string", "node2 string", "numhists bigint", "likelihood double"))


def file_gene_orders(spark, d):
    """Genes with the profiles of the segment of their own number."""
    genes = views.genes(spark, d).withColumn("seg_id", F.col("gene_id"))
    profiles = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("seg_id"), F.round(F.col("l_discount") / 2, 4).alias("likelihood"), F.col("l_tax").alias("preval"), (F.col("l_quantity") / 100).alias("preval_sd"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    back = _through(spark, writers.gene_order_lines(genes, profiles, order="place"), _columns("chrom string", "start bigint", "finish bigint", "name string", "total double", "likelihood double", "preval double", "preval_sd double"))
    return back.withColumn("total", F.round(F.col("total") + 1e-10, 4))


def file_breakends(spark, d):
    rows = views.sv_calls(spark, d).select("chrom", "start", F.when(F.col("flag") == "A", "+").otherwise("-").alias("strand"), F.col("chrom").alias("chrom2"), F.col("finish").alias("start2"), F.lit("+").alias("strand2"))
    back = _through(spark, writers.breakend_lines(rows), readers.histories, "HISTORIES_0")
    return back.select("chrom", "start", "strand", "chrom2", "end", "strand2", "value")


def file_by_place(spark, d):
    """Calls by place, and what touches one region."""
    path = _path(spark, "edges")
    calls = views.sv_calls(spark, d).select((F.col("flag") == "A").alias("is_adj"), "chrom", "start", F.col("finish").alias("end"), "l_orderkey", "l_linenumber")
    writers.write_by_place(calls, path)
    return writers.read_region(spark, path, "chr3", 20_000, 90_000).select("is_adj", "chrom", "start", "end", "l_orderkey", "l_linenumber")


_POINTS = _SV + """, pt AS (SELECT l_orderkey, chrom, start, min(l_linenumber) AS n FROM sv_calls GROUP BY ALL), w AS (SELECT l_orderkey, list({'c': chrom, 's': start} ORDER BY n, chrom, start) AS p FROM pt GROUP BY l_orderkey),
    e AS (SELECT l_orderkey, len(p) AS n, i, p[i] AS a, p[i % len(p) + 1] AS b FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM w) t)"""
_ENDS = "ends AS (SELECT chrom, unnest([start, finish]) AS pos, concat('e', l_orderkey % 50) AS event, l_orderkey % 7 AS history_id FROM sv_calls), per AS (SELECT chrom, pos, event, max((history_id <> 0)::int) AS p, max((history_id = 0)::int) AS t FROM ends GROUP BY ALL)"

QUERIES = {
    # the walk from the lower end of its lowest edge: a walk over points, whatever way the edges were stored
    "canonical_cycles": (canonical_cycles, _POINTS + """, f AS (SELECT l_orderkey, arg_min({'i': i, 'back': a > b}, (least(a, b), greatest(a, b), CASE WHEN a > b THEN '-' ELSE '+' END, i)) AS f FROM e GROUP BY l_orderkey),
        s AS (SELECT e.l_orderkey, f.f.back AS back, CASE WHEN f.f.back THEN (f.f.i - i + n) % n ELSE (i - f.f.i + n) % n END AS k, CASE WHEN f.f.back THEN b ELSE a END AS x, CASE WHEN f.f.back THEN a ELSE b END AS y FROM e JOIN f USING (l_orderkey))
        SELECT l_orderkey, string_agg(concat(x.c, ':', x.s, CASE WHEN back THEN '(-)-' ELSE '(+)-' END, y.c, ':', y.s, CASE WHEN back THEN '(+)' ELSE '(-)' END), ',' ORDER BY k) AS segstr FROM s GROUP BY l_orderkey"""),
    "figure_eights": (figure_eights, None),
    "merged_segments": (merged_segments, "SELECT l_orderkey, 1 AS segments, (max(l_linenumber) - min(l_linenumber))::bigint * 100 + 100 AS bases FROM lineitem GROUP BY l_orderkey"),
    "edge_relations": (edge_relations, _POINTS + """, q AS (SELECT l_orderkey, a, b, p2 AS c FROM (SELECT e.*, w.p[(i + 1) % n + 1] AS p2 FROM e JOIN w USING (l_orderkey)) t),
        r AS (SELECT *, a.c = b.c AND b.c = c.c AS one, least(a.s, b.s) AS al, greatest(a.s, b.s) AS ah, least(b.s, c.s) AS bl, greatest(b.s, c.s) AS bh FROM q)
        SELECT l_orderkey, count(*) AS connected, count(*) FILTER (one AND ((al > bl AND al < bh AND ah > bh) OR (al < bl AND ah < bh AND ah > bl))) AS crossing, count(*) FILTER (a = c) AS same, count(*) FILTER (a = b AND b = c) AS equal,
          count(*) FILTER (a.c = b.c AND abs(a.s - b.s) = 1) AS breakpoints FROM r GROUP BY l_orderkey"""),
    "edge_scores": (edge_scores, _with("flow_edges", "hist_stats") + """SELECT segstr, count(*) AS numhists, round(sum((upper_cost + lower_cost <> 0)::int) / (SELECT count(*) FROM hist_stats WHERE upper_cost > 0 AND upper_cost + lower_cost <> 0) + 1e-10, 6) AS likelihood
        FROM (SELECT DISTINCT segstr, history_id FROM flow_edges) t LEFT JOIN hist_stats USING (history_id) GROUP BY segstr"""),
    "order_correction": (order_correction, _with("flow_edges") + """, t AS (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY ord, segstr, cnval, l_orderkey, l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY history_id) AS n FROM flow_edges),
        f AS (SELECT segstr, cnval, CASE WHEN n = 1 THEN 1.1 ELSE p / nullif(n - 1, 0)::double END AS x FROM t) SELECT segstr, cnval, round(avg(x) + 1e-10, 6) AS order_mean, round(stddev_pop(x) + 1e-10, 6) AS order_sd FROM f GROUP BY segstr, cnval"""),
    "accuracy_by_simulation": (accuracy_by_simulation, _with("flow_edges") + """SELECT l_orderkey % 50 AS sim, round(avg(preval) + 1e-10, 6) AS mean_score, min(preval) AS min_score, max(preval) AS max_score, count(DISTINCT segstr) AS nodes,
        count(*) FILTER (cnval > 0 AND ord > 3) AS tp, count(*) FILTER (cnval > 0 AND ord <= 3) AS fp, count(*) FILTER (cnval <= 0 AND ord > 3) AS fn, count(*) FILTER (cnval <= 0 AND ord <= 3) AS tn FROM flow_edges GROUP BY 1"""),
    "combined_counts": (combined_counts, _with("flow_edges") + """, r AS (SELECT l_orderkey % 5 AS sample, history_id % 10000 * 100 + l_orderkey % 7 AS place, count(*) AS n FROM flow_edges GROUP BY ALL)
        SELECT place, CASE WHEN count(*) = (SELECT count(DISTINCT sample) FROM r) THEN sum(n)::bigint END AS total FROM r GROUP BY place"""),
    "flow_totals": (flow_totals, """WITH p AS (SELECT l_orderkey AS edge, sum(round(l_extendedprice, 2)) AS found FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS edge, round(o_totalprice, 2) AS total FROM orders)
        SELECT edge, round(coalesce(found, 0), 2) AS found, coalesce(total, 0) AS total FROM p FULL JOIN o USING (edge) WHERE abs(coalesce(found, 0) - coalesce(total, 0)) > 100000"""),
    "file_bed": (file_bed, _with("genes") + "SELECT replace(chrom, 'chr', '') AS chrom, start, finish, name, '+' AS strand, 1.5::double AS score FROM genes"),
    "file_regions": (file_regions, _with("genes") + "SELECT gene_id::varchar AS label, chrom, '+' AS strand, start, finish FROM genes"),
    "file_lengths": (file_lengths, _SV + "SELECT chrom, max(finish) AS length FROM sv_calls GROUP BY chrom"),
    "file_histories": (file_histories, _SV + """, b AS (SELECT flag = 'A' AS is_adj, chrom, start, finish, l_orderkey % 25 AS history_id, l_linenumber AS k FROM sv_calls UNION ALL SELECT true, chrom, finish, start, l_orderkey % 25, l_linenumber FROM sv_calls WHERE flag = 'A')
        SELECT 3::bigint AS run, is_adj, chrom, history_id, 2::bigint AS cnval, count(*) AS n, sum(start)::bigint AS starts, sum(finish)::bigint AS ends, sum(k)::bigint AS places FROM b GROUP BY is_adj, chrom, history_id"""),
    "file_events": (file_events, event_queries._HS + ", " + event_queries._LIKELIHOOD + """, per AS (SELECT segstr, cnval, history_id // 10000 AS run, count(DISTINCT history_id) AS n FROM flow_edges GROUP BY ALL),
        bins AS (SELECT segstr, cnval, unnest(range(0, max(history_id // 10000) + 1)) AS run FROM flow_edges GROUP BY segstr, cnval),
        runs AS (SELECT segstr, cnval, count(n) AS numsims, string_agg(concat(run, ':', coalesce(n, 0)), ',' ORDER BY run) AS run_counts FROM bins LEFT JOIN per USING (segstr, cnval, run) GROUP BY segstr, cnval)
        SELECT concat(min(history_id * 100 + ord) // 100, '.', min(history_id * 100 + ord) % 100) AS event_id, segstr, cnval::bigint AS cnval, any_value(numhists) AS numhists, any_value(numsims) AS numsims, round(any_value(likelihood) + 1e-10, 6) AS likelihood,
        round(avg(preval) + 1e-10, 6) AS preval_mean, round(stddev_pop(ord) + 1e-10, 6) AS order_sd, any_value(run_counts) AS run_counts FROM flow_edges JOIN lik USING (segstr, cnval) JOIN runs USING (segstr, cnval) GROUP BY segstr, cnval"""),
    "file_segment_histories": (file_segment_histories, _SV + "SELECT chrom, start, finish, value AS likelihood, l_linenumber::bigint AS numhists, -1.0::double AS cn_sum, round(value + 0.5, 6) AS p_sum, 0.25::double AS sd, concat('o', l_orderkey) AS label FROM sv_calls"),
    "file_confusion": (file_confusion, "WITH m AS (SELECT * FROM (" + event_queries.QUERIES["confusion_matrix"][1] + """) x), u AS (UNPIVOT (SELECT type, tp AS TP, fp AS FP, fn AS FN, tn AS TN, ex AS EX FROM m) ON TP, FP, FN, TN, EX INTO NAME measure VALUE n)
        SELECT measure, coalesce(sum(n) FILTER (type = 'any'), 0)::bigint AS "any", coalesce(sum(n) FILTER (type = 'amp'), 0)::bigint AS amp, coalesce(sum(n) FILTER (type = 'del'), 0)::bigint AS del, coalesce(sum(n) FILTER (type = 'oth'), 0)::bigint AS oth, coalesce(sum(n) FILTER (type = 'amdl'), 0)::bigint AS amdl FROM u GROUP BY measure"""),
    "file_breakpoints": (file_breakpoints, _SV + ", " + _ENDS + " SELECT chrom, pos, sum(p)::bigint AS n_pred, sum(t)::bigint AS n_true, (sum(p) FILTER (event < 'e3'))::bigint AS n2, (sum(t) FILTER (event < 'e3'))::bigint AS t2 FROM per GROUP BY chrom, pos HAVING count(*) FILTER (event < 'e3') > 0"),
    "file_links": (file_links, "WITH l AS (SELECT * FROM (" + event_queries.QUERIES["event_links"][1] + ") x) SELECT concat(segstr, '/', cnval) AS node1, concat(next_segstr, '/', next_cnval) AS node2, numhists, round(numhists / 100, 4) AS likelihood FROM l"),
    "file_gene_orders": (file_gene_orders, _with("genes") + """, p AS (SELECT l_partkey AS gene_id, sum(round(l_discount / 2, 4)) AS total, max({'l': round(l_discount / 2, 4), 'p': l_tax, 's': l_quantity / 100}) AS b FROM lineitem GROUP BY 1)
        SELECT chrom, start, finish, name, round(coalesce(total, 0) + 1e-10, 4) AS total, CASE WHEN total > 0.5 THEN b.l ELSE 0 END AS likelihood, CASE WHEN total > 0.5 THEN b.p ELSE 0 END AS preval, CASE WHEN total > 0.5 THEN b.s ELSE 0 END AS preval_sd FROM genes LEFT JOIN p USING (gene_id)"""),
    "file_breakends": (file_breakends, _SV + "SELECT chrom, start, CASE WHEN flag = 'A' THEN '-' ELSE '+' END AS strand, chrom AS chrom2, finish AS \"end\", '-' AS strand2, 1000.0::double AS value FROM sv_calls"),
    "file_by_place": (file_by_place, _SV + "SELECT flag = 'A' AS is_adj, chrom, start, finish AS \"end\", l_orderkey, l_linenumber FROM sv_calls WHERE chrom = 'chr3' AND CASE WHEN flag = 'A' THEN start BETWEEN 20000 AND 90000 ELSE finish > start AND start <= 90000 AND finish >= 20000 END"),
}
