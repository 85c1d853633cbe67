"""Round trips of whole tables through the text formats of callers and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events
from ..operators.shared import materialize
from ..sources import readers, views, writers
from . import file_queries
from .event_queries import _r, _with
from .file_queries import _columns, _path, _through, _walks

_BE, _SV = _with("breakends"), _with("sv_calls")
_SIDES = ["chrom", "start", "finish", "strand", "chrom2", "start2", "finish2", "strand2", "coverage"]


def _lines(*columns):
    return F.concat_ws("\t", *(c.cast("string") for c in columns)).alias("value")


def _calls(spark, d):
    """Columns of the breakend table as callers write them: a strand of ours is their minus."""
    rows = views.breakends(spark, d)
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    return rows, {c: F.col(c) for c in rows.columns} | {"strand": sign("strand"), "strand2": sign("strand2")}


def _bare(c):
    return readers.without_prefix(F.col(c))


def file_calls_legacy(spark, d):
    """Twelve columns; every tenth call has a negative score, which drops it."""
    rows, c = _calls(spark, d)
    score = F.when(F.col("start") % 100 == 0, -1).otherwise(7)
    text = rows.select(_lines(_bare("chrom"), c["start"], c["finish"], c["strand"], _bare("chrom2"), c["start2"], c["finish2"], c["strand2"], F.when(c["strand"] == "-", "GERMLINE").otherwise("SOMATIC"), c["coverage"], F.lit("x"), score))
    return _through(spark, text, readers.breakends).select(*_SIDES, "germline")


def file_calls_pairs(spark, d):
    rows, c = _calls(spark, d)
    place = lambda a, b, e: F.concat(_bare(a), F.lit(":"), F.col(b), F.lit("-"), F.col(e))
    score = F.when(F.col("start") % 100 == 0, -1).otherwise(7)
    text = rows.select(_lines(place("chrom", "start", "finish"), place("chrom2", "finish2", "start2"), c["strand"], c["strand2"], F.when(c["strand"] == "-", "germline").otherwise("somatic"), c["coverage"], F.lit("x"), F.lit("y"), score))
    return _through(spark, text, lambda s, p: readers.breakends(s, p, "pairs")).select(*_SIDES, "germline")


def file_calls_tabbed(spark, d):
    rows, c = _calls(spark, d)
    x = F.lit("x")
    text = rows.select(_lines(_bare("chrom"), x, x, x, c["start"], c["finish"], _bare("chrom2"), c["start2"], c["finish2"], c["strand"], c["strand2"], c["coverage"]))
    return _through(spark, text, lambda s, p: readers.breakends(s, p, "tabbed")).select(*_SIDES, "germline")


def file_copy_numbers(spark, d):
    """Plain rows, and those that a mixed file marks."""
    rows = views.sv_calls(spark, d)
    plain = rows.select(_lines(_bare("chrom"), F.col("start"), F.col("finish"), F.col("value")))
    mixed = rows.select(_lines(F.when(F.col("flag") == "R", "BND").otherwise("CNV"), _bare("chrom"), F.col("start"), F.col("finish"), F.col("value")))
    one = _through(spark, plain, readers.copy_numbers).withColumn("mixed", F.lit(False))
    return one.unionByName(_through(spark, mixed, lambda s, p: readers.copy_numbers(s, p, mixed=True)).withColumn("mixed", F.lit(True)))


def file_haplotypes(spark, d):
    """Germline alleles and somatic counts of each line; an allele without a count has none."""
    rows = views.sv_calls(spark, d)
    n = F.col("l_orderkey") % 50
    germline = F.lit("A:9 1/G:8 2")
    somatic = F.when(F.col("flag") == "A", F.concat(F.lit("A:"), n)).otherwise(F.concat(F.lit("G:"), n, F.lit(" A:"), n + F.col("l_linenumber")))
    x = F.lit("x")
    text = rows.select(_lines(F.when(F.col("flag") == "R", "CNV").otherwise("HAP"), _bare("chrom"), F.col("start"), x, x, x, germline, somatic))
    return _through(spark, text, readers.haplotype_snps)


def file_vcf_breakends(spark, d):
    """Two mates a record; records of other kinds and filters are left out."""
    rows, c = _calls(spark, d)
    alt = lambda open_: F.concat(F.lit(f"N{open_}"), F.col("chrom2"), F.lit(":"), F.col("start2"), F.lit(open_))
    info = F.concat(F.when(F.col("finish") % 7 == 0, "SVTYPE=DEL").otherwise("SVTYPE=BND"), F.lit(";MATEID=m1,m2;PARID=p"))
    sample = F.concat(F.lit("30:"), F.col("coverage").cast("bigint"), F.lit(","), F.col("coverage").cast("bigint") + 1)
    text = rows.select(_lines(F.col("chrom"), F.col("start"), F.col("breakend_id"), F.lit("N"), F.concat(alt("["), F.lit(","), alt("]")), F.lit("9"), F.when(F.col("start") % 100 == 0, "q10").otherwise("PASS"), info, F.lit("DP:BDP"), sample))
    head = spark.createDataFrame([("##fileformat=VCFv4.1",), ("#CHROM\tPOS",)], "value string")
    return _through(spark, head.unionByName(text), readers.vcf_breakends)


def file_vcf_snvs(spark, d):
    rows = views.sv_calls(spark, d)
    info = F.concat(F.lit("VT=SNP;SS="), F.when(F.col("l_linenumber") > 2, "Somatic").otherwise("Germline"), F.when(F.col("flag") == "R", ";DB").otherwise(""))
    sample = F.concat(F.col("l_orderkey") % 90 + 10, F.lit(":0.25"))
    text = rows.select(_lines(F.col("chrom"), F.col("start"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("9"), F.when(F.col("flag") == "A", "PASS").otherwise("."), info, F.lit("DP:FA"), sample))
    return _through(spark, text, readers.vcf_somatic_snvs)


def file_segmentation(spark, d):
    """Segmenter output, chromosomes by number, and its coverage graph."""
    rows = views.sv_calls(spark, d).withColumn("k", F.expr("cast(substring(chrom, 4) AS int)"))
    text = rows.select(_lines(F.concat(F.lit("s"), F.col("l_linenumber")), F.col("k"), F.col("start"), F.col("finish"), F.col("l_linenumber"), F.col("value")))
    head = spark.createDataFrame([("ID\tchrom\tloc.start\tloc.end\tnum.mark\tseg.mean",)], "value string")
    held = _through(spark, head.unionByName(text), readers.segmentation).withColumn("kind", F.lit("segment"))
    graph = _through(spark, writers.coverage_graph(rows.select(F.col("k").alias("chrom"), "start", "finish", F.col("value").alias("mean"))), _columns("chrom string", "start bigint", "finish bigint", "value double"))
    return held.unionByName(graph.withColumn("kind", F.lit("graph")), allowMissingColumns=True)


def file_history_stats(spark, d):
    """The costs of every history, a file a run."""
    rows = views.hist_stats(spark, d)
    root, run = _path(spark, "runs"), F.floor(F.col("history_id") / views.RUN_STRIDE)
    runs = [r[0] for r in rows.select(run.alias("r")).distinct().orderBy("r").collect()]
    for r in runs:
        own = rows.where(run == r).withColumns({c: F.lit(k) for k, c in enumerate(("error", "length", "median_length", "max_length"))})
        writers.stats_lines(own.orderBy("upper_cost", "lower_cost").coalesce(1)).write.text(f"{root}/HISTORY_STATS_{r}")
    return readers.history_stats(spark, f"{root}/*")


def _scored(spark, d):
    """Lines as scored events with all columns of the reports."""
    rows = views.flow_edges(spark, d).groupBy("segstr", "cnval").agg(F.count(F.lit(1)).alias("numhists"), F.max("preval").alias("preval_mean"), F.min("ord").cast("double").alias("order_mean"))
    n = F.col("numhists")
    return rows.select(F.concat("segstr", F.lit("."), "cnval").alias("event_id"), F.when(F.col("cnval") > 0, "amp").otherwise("del").alias("event_type"), (n / 2).alias("avecost"), (n / 1024).alias("likelihood"), "cnval", (n * 10).alias("length"), (n + 1).alias("numsegs"), "preval_mean", F.lit(0.5).alias("preval_sd"), "order_mean", F.lit(0.25).alias("order_sd"), "numhists", (n % 3 - 1).alias("true"), F.lit(0.125).alias("ref_preval"), F.lit(2.0).alias("ref_order"))


def file_event_table(spark, d):
    names = ["event_id string", "event_type string", "avecost double", "likelihood double", "cnval int", "length bigint", "numsegs bigint", "preval_mean double", "preval_sd double", "order_mean double", "order_sd double", "numhists bigint"]
    return _through(spark, writers.event_table_lines(_scored(spark, d)), _columns(*names))


def file_simulation_table(spark, d):
    names = ["event_id string", "event_type string", "avecost double", "likelihood double", "cnval int", "true bigint", "length bigint", "prevals string", "orders string", "numhists bigint"]
    back = _through(spark, writers.simulation_lines(_scored(spark, d)), _columns(*names))
    part = lambda c, k, n: F.get(F.split(c, ","), F.lit(k)).cast("double").alias(n)
    return back.select("event_id", "true", "length", "numhists", part("prevals", 0, "ref_preval"), part("prevals", 1, "preval_mean"), part("orders", 0, "ref_order"), part("orders", 1, "order_mean"))


def file_annotations(spark, d):
    rows = views.genes(spark, d).groupBy("chrom").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("genes"))
    return _through(spark, writers.annotation_lines(rows.select(F.col("chrom").alias("event"), "genes")), _columns("event string", "genes string"))


def file_analyses(spark, d):
    """Per-gene rows, behind a comment."""
    rows = views.genes(spark, d)
    k = F.col("gene_id")
    text = rows.select(_lines(k, *((k * j % 17 / 4) for j in range(1, 7)), F.col("name")))
    return _through(spark, spark.createDataFrame([("# name and figures",)], "value string").unionByName(text), readers.analyses)


def files_to_events(spark, d):
    """History files to scored events: the orders' walks written as sampled cycles, read, put in canonical form, merged and scored."""
    steps = _walks(spark, d).select("l_orderkey", F.posexplode("edges").alias("edge_index", "e")).select("l_orderkey", "edge_index", "e.*")
    zero = [F.lit(0).alias(c) for c in ("net", "upper_cost", "lower_cost", "event_upper", "event_lower")]
    sampled = steps.select("is_adj", "chrom", "start", "strand", "chrom2", "end", "strand2", (-F.col("value")).alias("flow"), F.lit(0.5).alias("prevalence"), (F.col("l_orderkey") % 25).alias("history_id"), F.col("l_orderkey").alias("cycle"), "edge_index", (F.col("l_orderkey") % 9).alias("ord"), F.lit("p").alias("event_ptr"), *zero)
    back = _through(spark, writers.history_lines(sampled), readers.histories, "HISTORIES_3")
    found = events.summary(materialize(events.occurrences_of(back), "occurrences"), views.hist_stats(spark, d))
    return found.select("segstr", "cnval", "numhists", "num_runs", _r("likelihood"), _r("preval_mean"), _r("order_mean"), _r("order_sd"))


def file_simulations(spark, d):
    """Specifications and folders of simulations."""
    rows = views.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("blocks"), (F.col("o_orderkey") % 40).alias("events"))
    specs = _through(spark, rows.select(F.concat_ws(" ", "blocks", "events").alias("value")), readers.simulation_specs).withColumn("sim_id", F.lit("none"))
    dirs = _through(spark, rows.select(_lines(F.lit("dir"), F.col("o_orderkey"), F.col("blocks"), F.col("events"))), readers.simulation_dirs).drop("dir")
    return specs.unionByName(dirs)


_SCORED = _with("flow_edges") + """, s AS (SELECT concat(segstr, '.', cnval) AS event_id, cnval, count(*) AS n, max(preval) AS preval_mean, min(ord)::double AS order_mean FROM flow_edges GROUP BY segstr, cnval)"""

QUERIES = {
    "file_calls_legacy": (file_calls_legacy, _BE + f"SELECT {', '.join(_SIDES)}, strand AS germline FROM breakends WHERE start % 100 <> 0"),
    "file_calls_pairs": (file_calls_pairs, _BE + f"SELECT {', '.join(_SIDES)}, strand AS germline FROM breakends WHERE start % 100 <> 0"),
    "file_calls_tabbed": (file_calls_tabbed, _BE + f"SELECT {', '.join(_SIDES)}, false AS germline FROM breakends"),
    "file_copy_numbers": (file_copy_numbers, _SV + "SELECT chrom, start, finish, value, false AS mixed FROM sv_calls UNION ALL SELECT chrom, start, finish, value, true FROM sv_calls WHERE flag <> 'R'"),
    "file_haplotypes": (file_haplotypes, _SV + """SELECT chrom, start AS pos, CASE WHEN flag = 'A' THEN 0 ELSE l_orderkey % 50 END AS minor, CASE WHEN flag = 'A' THEN l_orderkey % 50 ELSE l_orderkey % 50 + l_linenumber END AS major FROM sv_calls WHERE flag <> 'R'"""),
    "file_vcf_breakends": (file_vcf_breakends, _BE + """SELECT breakend_id AS id, chrom, start AS pos, CASE WHEN mate = 0 THEN 'm1' ELSE 'm2' END AS mate_id, 'p' AS partner_id, chrom2, start2 AS pos2, mate = 0 AS strand2, mate, coverage::bigint::double + mate AS coverage, 30.0::double AS segment
        FROM breakends, (SELECT unnest([0, 1])::int AS mate) m WHERE finish % 7 <> 0 AND start % 100 <> 0"""),
    "file_vcf_snvs": (file_vcf_snvs, _SV + "SELECT chrom, start AS pos, floor((l_orderkey % 90 + 10) * 0.25)::bigint AS mutant, l_orderkey % 90 + 10 AS total FROM sv_calls WHERE l_linenumber > 2 AND flag <> 'R'"),
    "file_segmentation": (file_segmentation, _SV + """, n AS (SELECT *, substr(chrom, 4)::int AS k FROM sv_calls), m AS (SELECT *, CASE WHEN k = 23 THEN 'chrX' WHEN k = 24 THEN 'chrY' ELSE chrom END AS c FROM n)
        SELECT concat('s', l_linenumber) AS sample, c AS chrom, start, finish, l_linenumber::int AS num_marks, value, concat('CNV:', c, ':', (start + finish) // 2) AS name, 'segment' AS kind FROM m
        UNION ALL SELECT NULL, c, start, finish, NULL, value, NULL, 'graph' FROM m"""),
    "file_history_stats": (file_history_stats, _with("hist_stats") + """SELECT row_number() OVER (PARTITION BY history_id // 10000 ORDER BY upper_cost, lower_cost) - 1 + history_id // 10000 * 10000 AS history_id, history_id // 10000 AS run,
        upper_cost::bigint AS upper_cost, lower_cost::bigint AS lower_cost, 0::bigint AS error, 1::bigint AS length, 2::bigint AS median_length, 3::bigint AS max_length FROM hist_stats"""),
    "file_event_table": (file_event_table, _SCORED + "SELECT event_id, CASE WHEN cnval > 0 THEN 'amp' ELSE 'del' END AS event_type, n / 2 AS avecost, n / 1024 AS likelihood, cnval, n * 10 AS length, n + 1 AS numsegs, preval_mean, 0.5::double AS preval_sd, order_mean, 0.25::double AS order_sd, n AS numhists FROM s"),
    "file_simulation_table": (file_simulation_table, _SCORED + 'SELECT event_id, n % 3 - 1 AS "true", n * 10 AS length, n AS numhists, 0.125::double AS ref_preval, preval_mean, 2.0::double AS ref_order, order_mean FROM s'),
    "file_annotations": (file_annotations, _with("genes") + "SELECT chrom AS event, string_agg(DISTINCT name, ',' ORDER BY name) AS genes FROM genes GROUP BY chrom"),
    "file_analyses": (file_analyses, _with("genes") + "SELECT gene_id::varchar AS name, " + ", ".join(f"gene_id * {j} % 17 / 4 AS stat{j}" for j in range(1, 7)) + ", name AS partners FROM genes"),
    "files_to_events": (files_to_events, f"""WITH hist_stats AS ({views.SQL["hist_stats"]}), walks AS ({file_queries.QUERIES["canonical_cycles"][1]}), occ AS (SELECT segstr, 30000 + l_orderkey % 25 AS history_id, l_orderkey % 9 AS ord FROM walks),
        total AS (SELECT count(*) AS t FROM hist_stats WHERE upper_cost > 0 AND upper_cost + lower_cost <> 0),
        lik AS (SELECT segstr, count(*) AS numhists, count(*) FILTER (upper_cost + lower_cost <> 0) AS w FROM (SELECT DISTINCT segstr, history_id FROM occ) h LEFT JOIN hist_stats USING (history_id) GROUP BY segstr)
        SELECT segstr, 2::bigint AS cnval, numhists, 1::bigint AS num_runs, round(w / t + 1e-10, 6) AS likelihood, 0.5::double AS preval_mean, round(avg(ord) + 1e-10, 6) AS order_mean, round(stddev_pop(ord) + 1e-10, 6) AS order_sd FROM occ JOIN hist_stats USING (history_id) JOIN lik USING (segstr), total GROUP BY segstr, numhists, w, t"""),
    "file_simulations": (file_simulations, "SELECT (o_custkey % 200)::int AS blocks, (o_orderkey % 40)::int AS events, 'none' AS sim_id FROM orders UNION ALL SELECT (o_custkey % 200)::int, (o_orderkey % 40)::int, o_orderkey::varchar FROM orders"),
}
