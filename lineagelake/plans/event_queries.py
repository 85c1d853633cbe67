"""Queries over events of sampled histories, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cycles
from ..operators import diagnostics, events
from ..sources import views


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({views.SQL[n]})" for n in names) + " "


def _r(column: str, name: str | None = None):
    """Rounded to six places; the small term settles ties that summing order would decide."""
    return F.round(F.col(column) + 1e-10, 6).alias(name or column)


def _occ(spark, d):
    return views.flow_edges(spark, d)


def _stats(spark, d):
    return views.hist_stats(spark, d)


_TIE = ("l_orderkey", "l_linenumber")  # not unique: callers add values
_LIKELIHOOD = """lik AS (SELECT segstr, cnval, count(*) AS numhists, sum(CASE WHEN upper_cost + lower_cost <> 0 THEN 1.0 ELSE 0.0 END) / (SELECT count(*) FROM hist_stats WHERE upper_cost > 0 AND upper_cost + lower_cost <> 0) AS likelihood
  FROM (SELECT DISTINCT segstr, cnval, history_id FROM flow_edges) o LEFT JOIN hist_stats USING (history_id) GROUP BY segstr, cnval)"""
_FE, _HS = _with("flow_edges"), _with("flow_edges", "hist_stats")


def event_likelihood(spark, d):
    out = events.likelihood(_occ(spark, d), _stats(spark, d))
    return out.select("segstr", "cnval", "numhists", _r("likelihood"))


def event_likelihood_weighted(spark, d):
    out = events.likelihood(_occ(spark, d), _stats(spark, d), k=0.5)
    return out.select("segstr", "cnval", "numhists", _r("likelihood"))


def event_timing(spark, d):
    out = events.timing(_occ(spark, d), _stats(spark, d))
    return out.select("segstr", "cnval", *(_r(c) for c in ("preval_mean", "preval_sd", "order_mean", "order_sd")))


def event_timing_weighted(spark, d):
    out = events.timing(_occ(spark, d), _stats(spark, d), k=0.25)
    return out.select("segstr", "cnval", *(_r(c) for c in ("preval_mean", "order_mean")))


def run_counts(spark, d):
    return events.run_counts(_occ(spark, d))


def merged_events(spark, d):
    out = events.merge(_occ(spark, d))
    listed = F.transform("occurrences", lambda x: F.concat_ws(":", x.history_id.cast("string"), x.ord.cast("string")))
    return out.select("segstr", "cnval", F.size("occurrences").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort(listed), ",")).alias("members"))


def event_summary(spark, d):
    out = events.summary(_occ(spark, d), _stats(spark, d))
    return out.select("segstr", "cnval", "event_id", "numhists", _r("likelihood"), _r("preval_mean"), _r("order_sd"), "num_runs")


def events_by_type(spark, d):
    occ = events.by_type(_occ(spark, d))
    return events.likelihood(occ, _stats(spark, d)).select("segstr", "cnval", "numhists", _r("likelihood"))


def edges_ignore_cn(spark, d):
    occ = events.ignoring_copy_number(_occ(spark, d), _TIE)
    return occ.groupBy("segstr").agg(F.count(F.lit(1)).alias("numhists"), F.round(F.avg("preval") + 1e-10, 6).alias("preval_mean"))


def split_duplicates(spark, d):
    occ = events.split_duplicates(_occ(spark, d), _TIE)
    return occ.groupBy("segstr", "cnval", F.col("copy").cast("bigint").alias("copy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("preval") + 1e-10, 6).alias("preval_sum"))


def dedup_adjacency(spark, d):
    occ = events.first_of_cycle_order(_occ(spark, d), ("history_id", "segstr"), "ord", (*_TIE, "cnval", "preval"))
    return occ.groupBy("history_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("cnval").cast("bigint").alias("cn"))


def sequence_ids(spark, d):
    occ = events.sequence_ids(_occ(spark, d).withColumn("run", events.run_of(F.col("history_id"))), ("run", "segstr"), (*_TIE, "history_id", "ord"))
    return occ.groupBy("run", "segstr").agg(F.max("event_seq").cast("bigint").alias("events"), F.max("history_seq").cast("bigint").alias("histories"))


def event_links(spark, d):
    return events.links(_occ(spark, d))


def breakpoint_counts(spark, d):
    calls = views.sv_calls(spark, d)
    ends = calls.select("chrom", F.explode(F.array("start", "finish")).alias("pos"), F.concat(F.lit("e"), (F.col("l_orderkey") % 50).cast("string")).alias("event"), (F.col("l_orderkey") % 7).alias("history_id"))
    return events.breakpoint_counts(ends, 0)


def rank_fraction(spark, d):
    out = diagnostics.rank_fractions(_occ(spark, d), _TIE)
    return out.groupBy("segstr", "cnval").agg(F.round(F.avg("fraction") + 1e-10, 6).alias("fraction_mean"), F.count(F.lit(1)).alias("n"))


def early_late(spark, d):
    return diagnostics.early_late(diagnostics.rank_fractions(_occ(spark, d), _TIE))


def order_pair_counts(spark, d):
    occ, stats = _occ(spark, d), _stats(spark, d)
    kept = events.likelihood(occ, stats).where(F.col("likelihood") > 0.55).select(*events.KEY)
    return diagnostics.order_pairs(occ.join(kept, list(events.KEY), "left_semi"))


def likelihood_over_time(spark, d):
    out = diagnostics.likelihood_over_time(_occ(spark, d), _stats(spark, d))
    return out.select("segstr", "cnval", "run", "iteration", _r("likelihood"))


def events_above_over_time(spark, d):
    out = diagnostics.likelihood_over_time(_occ(spark, d), _stats(spark, d), k=0.5)
    return diagnostics.counts_above(out.withColumn("likelihood", F.round("likelihood", 9)), 0.05)


def mixing_jaccard(spark, d):
    out = diagnostics.mixing(_occ(spark, d), 3)
    return out.select("run", "history_id", "n_own", "n_ref", "n_both", _r("jaccard"))


def confusion_matrix(spark, d):
    """Orders as events: their lines' signs give the type, two thresholds stand for prediction and truth."""
    value = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1)
    rows = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("l_linenumber", value.alias("v"))))).alias("o"), F.avg("l_discount").alias("likelihood"), F.max("l_quantity").alias("avecost"), (F.max("l_tax") > 0.07).alias("true"), (F.count(F.lit(1)) % 3 == 0).alias("explained")
    )
    kind = F.element_at(F.array(F.lit("amp"), F.lit("del"), F.lit("oth"), F.lit("amdl")), cycles.event_type(F.col("o.v")))
    typed = diagnostics.called(rows.select(kind.alias("type"), F.round("likelihood", 9).alias("likelihood"), (F.col("avecost") - 20).alias("avecost"), "true", "explained"), 0.05)
    return diagnostics.confusion(typed).select("type", "tp", "fp", "fn", "tn", "ex", _r("f1"))


def optimal_histories(spark, d):
    return diagnostics.optimal_histories(_stats(spark, d)).select("history_id", F.col("upper_cost").cast("bigint").alias("upper_cost"), F.col("number").cast("bigint").alias("number"))


def history_length_stats(spark, d):
    occ = _occ(spark, d).withColumn("length", F.col("ord").cast("bigint") * 3 % 11)
    return diagnostics.length_stats(occ)


def events_per_history(spark, d):
    return diagnostics.events_per_history(_occ(spark, d))


def score_pairs(spark, d):
    out = diagnostics.score_pairs(_stats(spark, d), 12)
    return out.select("late", F.col("upper_cost").cast("bigint").alias("upper_cost"), F.col("lower_cost").cast("bigint").alias("lower_cost"), "histories")


def region_dup_del_stats(spark, d):
    segs = _occ(spark, d).select(F.col("segstr").alias("region"), "history_id", F.col("cnval").cast("double").alias("value"), "ord")
    out = diagnostics.region_stats(segs, _stats(spark, d))
    return out.select("region", "gain", _r("mean_count"), _r("mean_order"), _r("mean_value"))


def region_shared_cycles(spark, d):
    m = _occ(spark, d).select(F.col("segstr").alias("region"), F.concat_ws(".", F.col("history_id").cast("string"), (F.col("l_orderkey") % 40).cast("string")).alias("cycle"))
    return diagnostics.shared_cycles(m).select("region", "other", "shared", F.col("rank").cast("bigint").alias("rank"), _r("share"))


def merged_analyses(spark, d):
    rows = _occ(spark, d).select("segstr", "preval", F.col("ord").cast("double").alias("ord"), F.concat(F.lit("g"), (F.col("l_orderkey") % 5).cast("string")).alias("genes"))
    out = diagnostics.merge_analyses(rows, "segstr", ["preval", "ord"], "genes")
    return out.select("segstr", _r("preval"), _r("ord"), "genes")


def allelic_variance(spark, d):
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey"), (F.col("o_totalprice") / 1000).alias("low"), (F.col("o_custkey") / 100.0).alias("high"))
    return diagnostics.allelic_variance(rows, ["o_orderkey"]).select(F.col("half").cast("bigint").alias("half"), "n", F.round("variance", 3).alias("variance"))


def regression_fit(spark, d):
    rows = views.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    out = diagnostics.regression(rows, "l_returnflag")
    return out.select("l_returnflag", _r("slope"), _r("intercept"), _r("r2"), "n")


QUERIES = {
    "event_likelihood": (event_likelihood, _HS + ", " + _LIKELIHOOD + " SELECT segstr, cnval, numhists, round(likelihood + 1e-10, 6) AS likelihood FROM lik"),
    "event_likelihood_weighted": (event_likelihood_weighted, _HS + """SELECT segstr, cnval, count(*) AS numhists, round(sum(CASE WHEN upper_cost + lower_cost <> 0 THEN exp(-0.25 * (upper_cost + lower_cost)) ELSE 0 END)
        / (SELECT sum(exp(-0.25 * (upper_cost + lower_cost))) FROM hist_stats WHERE upper_cost > 0) + 1e-10, 6) AS likelihood
        FROM (SELECT DISTINCT segstr, cnval, history_id FROM flow_edges) o LEFT JOIN hist_stats USING (history_id) GROUP BY segstr, cnval"""),
    "event_timing": (event_timing, _FE + "SELECT segstr, cnval, round(avg(preval) + 1e-10, 6) AS preval_mean, round(stddev_pop(preval) + 1e-10, 6) AS preval_sd, round(avg(ord) + 1e-10, 6) AS order_mean, round(stddev_pop(ord) + 1e-10, 6) AS order_sd FROM flow_edges GROUP BY segstr, cnval"),
    "event_timing_weighted": (event_timing_weighted, _HS + "SELECT segstr, cnval, round(sum(exp(-0.25 * upper_cost) * preval) / sum(exp(-0.25 * upper_cost)) + 1e-10, 6) AS preval_mean, round(sum(exp(-0.25 * upper_cost) * ord) / sum(exp(-0.25 * upper_cost)) + 1e-10, 6) AS order_mean FROM flow_edges JOIN hist_stats USING (history_id) GROUP BY segstr, cnval"),
    "run_counts": (run_counts, _FE + """, per AS (SELECT segstr, cnval, history_id // 10000 AS run, count(DISTINCT history_id) AS n FROM flow_edges GROUP BY ALL),
        bins AS (SELECT segstr, cnval, unnest(range(0, max(history_id // 10000) + 1)) AS run FROM flow_edges GROUP BY segstr, cnval)
        SELECT segstr, cnval, count(n) AS num_runs, string_agg(concat(run, ':', coalesce(n, 0)), ',' ORDER BY run) AS counts FROM bins LEFT JOIN per USING (segstr, cnval, run) GROUP BY segstr, cnval"""),
    "merged_events": (merged_events, _FE + "SELECT segstr, cnval, count(*) AS n, md5(string_agg(concat(history_id, ':', ord), ',' ORDER BY concat(history_id, ':', ord))) AS members FROM flow_edges GROUP BY segstr, cnval"),
    "event_summary": (event_summary, _HS + ", " + _LIKELIHOOD + """ SELECT segstr, cnval, concat(min(history_id * 100 + ord) // 100, '.', min(history_id * 100 + ord) % 100) AS event_id, any_value(numhists) AS numhists, round(any_value(likelihood) + 1e-10, 6) AS likelihood,
        round(avg(preval) + 1e-10, 6) AS preval_mean, round(stddev_pop(ord) + 1e-10, 6) AS order_sd, count(DISTINCT history_id // 10000) AS num_runs FROM flow_edges JOIN lik USING (segstr, cnval) GROUP BY segstr, cnval"""),
    "events_by_type": (events_by_type, _with("flow_edges", "hist_stats").replace("flow_edges AS", "raw_edges AS") + ", flow_edges AS (SELECT * REPLACE (sign(cnval)::int AS cnval) FROM raw_edges), " + _LIKELIHOOD + " SELECT segstr, cnval, numhists, round(likelihood + 1e-10, 6) AS likelihood FROM lik"),
    "edges_ignore_cn": (edges_ignore_cn, _FE + "SELECT segstr, count(*) AS numhists, round(avg(preval) + 1e-10, 6) AS preval_mean FROM (SELECT * FROM flow_edges QUALIFY row_number() OVER (PARTITION BY segstr, history_id ORDER BY cnval, preval, ord, l_orderkey, l_linenumber) = 1) t GROUP BY segstr"),
    "split_duplicates": (split_duplicates, _FE + """SELECT segstr, cnval, CASE WHEN p = n THEN 0 ELSE p END AS copy, count(*) AS n, round(sum(preval) + 1e-10, 6) AS preval_sum FROM
        (SELECT *, row_number() OVER (PARTITION BY segstr, cnval, history_id ORDER BY preval, ord, l_orderkey, l_linenumber) AS p, count(*) OVER (PARTITION BY segstr, cnval, history_id) AS n FROM flow_edges) t GROUP BY 1, 2, 3"""),
    "dedup_adjacency": (dedup_adjacency, _FE + "SELECT history_id, count(*) AS edges, sum(cnval)::bigint AS cn FROM (SELECT * FROM flow_edges QUALIFY row_number() OVER (PARTITION BY history_id, segstr, ord ORDER BY l_orderkey, l_linenumber, cnval, preval) = 1) t GROUP BY history_id"),
    "sequence_ids": (sequence_ids, _FE + """, t AS (SELECT history_id // 10000 AS run, segstr, l_orderkey, l_linenumber,
          lag(history_id) OVER w IS DISTINCT FROM history_id AS h, lag(history_id) OVER w IS DISTINCT FROM history_id OR lag(ord) OVER w <> ord AS e
          FROM flow_edges WINDOW w AS (PARTITION BY history_id // 10000, segstr ORDER BY l_orderkey, l_linenumber, history_id, ord))
        SELECT run, segstr, sum(e::int)::bigint AS events, sum(h::int)::bigint AS histories FROM t GROUP BY run, segstr"""),
    "event_links": (event_links, _FE + """, once AS (SELECT segstr, cnval, history_id, avg(preval) AS p FROM flow_edges GROUP BY ALL), m AS (SELECT *, round(avg(p) OVER (PARTITION BY segstr, cnval), 9) AS m FROM once),
        f AS (SELECT *, lead(segstr) OVER w AS next_segstr, lead(cnval) OVER w AS next_cnval FROM m WINDOW w AS (PARTITION BY history_id ORDER BY m, segstr, cnval))
        SELECT segstr, cnval, next_segstr, next_cnval, count(*) AS numhists FROM f WHERE next_segstr IS NOT NULL GROUP BY ALL"""),
    "breakpoint_counts": (breakpoint_counts, _with("sv_calls") + """, ends AS (SELECT chrom, unnest([start, finish]) AS pos, concat('e', l_orderkey % 50) AS event, l_orderkey % 7 AS history_id FROM sv_calls),
        per AS (SELECT chrom, pos, event, max((history_id <> 0)::int) AS p, max((history_id = 0)::int) AS t FROM ends GROUP BY ALL)
        SELECT chrom, pos, sum(p)::bigint AS n_pred, sum(t)::bigint AS n_true FROM per GROUP BY chrom, pos"""),
    "rank_fraction": (rank_fraction, _FE + """, t AS (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY ord, segstr, cnval, l_orderkey, l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY history_id) AS n FROM flow_edges)
        SELECT segstr, cnval, round(avg(CASE WHEN n = 1 THEN 1.1 ELSE p / nullif(n - 1, 0)::double END) + 1e-10, 6) AS fraction_mean, count(*) AS n FROM t GROUP BY segstr, cnval"""),
    "early_late": (early_late, _FE + """, t AS (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY ord, segstr, cnval, l_orderkey, l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY history_id) AS n FROM flow_edges),
        u AS (SELECT segstr, cnval, CASE WHEN n = 1 THEN 1.1 ELSE p / nullif(n - 1, 0)::double END <= 0.5 AS early FROM t)
        SELECT segstr, cnval, count(*) FILTER (early) AS early, count(*) FILTER (NOT early) AS late FROM u GROUP BY segstr, cnval"""),
    "order_pair_counts": (order_pair_counts, _HS + ", " + _LIKELIHOOD + """, o AS (SELECT history_id, segstr, cnval, min(ord) AS o FROM flow_edges SEMI JOIN (SELECT * FROM lik WHERE likelihood > 0.55) l USING (segstr, cnval) GROUP BY ALL)
        SELECT a.segstr AS a_segstr, a.cnval AS a_cnval, b.segstr AS b_segstr, b.cnval AS b_cnval, count(*) FILTER (a.o < b.o) AS a_first, count(*) FILTER (a.o > b.o) AS b_first, count(*) FILTER (a.o = b.o) AS together
        FROM o a JOIN o b USING (history_id) WHERE (a.segstr, a.cnval) < (b.segstr, b.cnval) GROUP BY 1, 2, 3, 4"""),
    "likelihood_over_time": (likelihood_over_time, _HS + """, runs AS (SELECT history_id, history_id // 10000 AS run, history_id % 10000 AS iteration, CASE WHEN upper_cost + lower_cost <> 0 THEN 1.0 ELSE 0.0 END::double AS w FROM hist_stats),
        r AS (SELECT *, sum(w) OVER (PARTITION BY run ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS all_w FROM runs)
        SELECT segstr, cnval, run, iteration, round(sum(w) OVER (PARTITION BY segstr, cnval, run ORDER BY iteration ROWS UNBOUNDED PRECEDING) / nullif(all_w, 0) + 1e-10, 6) AS likelihood
        FROM (SELECT DISTINCT segstr, cnval, history_id FROM flow_edges) o JOIN r USING (history_id)"""),
    "events_above_over_time": (events_above_over_time, _HS + """, runs AS (SELECT history_id, history_id // 10000 AS run, history_id % 10000 AS iteration, CASE WHEN upper_cost + lower_cost <> 0 THEN exp(-0.25 * (upper_cost + lower_cost)) ELSE 0 END AS w FROM hist_stats),
        r AS (SELECT *, sum(w) OVER (PARTITION BY run ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS all_w FROM runs),
        t AS (SELECT run, iteration, round(sum(w) OVER (PARTITION BY segstr, cnval, run ORDER BY iteration ROWS UNBOUNDED PRECEDING) / nullif(all_w, 0), 9) AS likelihood
        FROM (SELECT DISTINCT segstr, cnval, history_id FROM flow_edges) o JOIN r USING (history_id))
        SELECT run, iteration, count(*) FILTER (likelihood > 0.05) AS above, count(*) AS events FROM t GROUP BY run, iteration"""),
    "mixing_jaccard": (mixing_jaccard, _FE + """, held AS (SELECT DISTINCT segstr, cnval, history_id, history_id // 10000 AS run FROM flow_edges), ref AS (SELECT * FROM held WHERE history_id % 10000 = 3),
        sizes AS (SELECT run, count(*) AS n_ref FROM ref GROUP BY run), per AS (SELECT h.run, h.history_id, count(*) AS n_own, count(r.run) AS n_both FROM held h LEFT JOIN ref r ON h.run = r.run AND h.segstr = r.segstr AND h.cnval = r.cnval GROUP BY 1, 2)
        SELECT run, history_id, n_own, n_ref, n_both, round(n_both / (n_own + n_ref - n_both)::double + 1e-10, 6) AS jaccard FROM per JOIN sizes USING (run)"""),
    "confusion_matrix": (confusion_matrix, """WITH o AS (SELECT l_orderkey, list(CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 END ORDER BY l_linenumber, l_returnflag = 'A') FILTER (l_returnflag IN ('R', 'A')) AS v,
          round(avg(l_discount), 9) > 0.05 AND max(l_quantity) > 20 AS p, max(l_tax) > 0.07 AS t, count(*) % 3 = 0 AS e FROM lineitem GROUP BY l_orderkey),
        f AS (SELECT *, list_reduce(list_prepend(0, coalesce(v, [])), lambda s, c: CASE WHEN c < 0 AND s <> 2 THEN 1 WHEN c > 0 AND s <> 1 THEN 2 ELSE 4 END) AS k FROM o),
        n AS (SELECT CASE k WHEN 1 THEN 'amp' WHEN 2 THEN 'del' WHEN 4 THEN 'amdl' ELSE 'oth' END AS type, p, t, e FROM f),
        c AS (SELECT coalesce(type, 'any') AS type, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t AND e) AS ex FROM n GROUP BY ROLLUP (type))
        SELECT *, round(2.0 * (tp + ex) / nullif(2 * (tp + ex) + (fn - ex) + fp, 0) + 1e-10, 6) AS f1 FROM c"""),
    "optimal_histories": (optimal_histories, _with("hist_stats") + "SELECT history_id, upper_cost::bigint AS upper_cost, row_number() OVER (ORDER BY history_id) - 1 AS number FROM hist_stats WHERE (upper_cost, lower_cost) = (SELECT (upper_cost, lower_cost) FROM hist_stats ORDER BY upper_cost, lower_cost LIMIT 1)"),
    "history_length_stats": (history_length_stats, _FE + "SELECT history_id, count(*) AS events, max(ord::bigint * 3 % 11) AS max_length, list_sort(list(ord::bigint * 3 % 11))[count(*) // 2 + 1] AS median_length FROM flow_edges GROUP BY history_id"),
    "events_per_history": (events_per_history, _FE + "SELECT history_id, count(DISTINCT ord) AS orders, count(DISTINCT (segstr, cnval)) AS events FROM flow_edges GROUP BY history_id"),
    "score_pairs": (score_pairs, _with("hist_stats") + "SELECT history_id % 10000 >= 12 AS late, upper_cost::bigint AS upper_cost, lower_cost::bigint AS lower_cost, count(*) AS histories FROM hist_stats GROUP BY ALL"),
    "region_dup_del_stats": (region_dup_del_stats, _HS + """, a AS (SELECT sum(exp(-upper_cost::double)) AS w FROM hist_stats), per AS (SELECT segstr AS region, cnval > 0 AS gain, history_id, count(*) AS n, min(ord) AS o, sum(cnval)::double AS v FROM flow_edges GROUP BY ALL),
        s AS (SELECT region, gain, sum(exp(-upper_cost::double) * n) AS n, sum(exp(-upper_cost::double) * o) AS o, sum(exp(-upper_cost::double) * v) AS v, sum(exp(-upper_cost::double)) AS sw FROM per JOIN hist_stats USING (history_id) GROUP BY ALL)
        SELECT region, gain, round(n / a.w + 1e-10, 6) AS mean_count, round((o + 1000 * (a.w - sw)) / a.w + 1e-10, 6) AS mean_order, round(v / a.w + 1e-10, 6) AS mean_value FROM s, a"""),
    "region_shared_cycles": (region_shared_cycles, _FE + """, m AS (SELECT DISTINCT segstr AS region, concat(history_id, '.', l_orderkey % 40) AS cycle FROM flow_edges), size AS (SELECT region, count(*) AS cycles FROM m GROUP BY region),
        shared AS (SELECT a.region, b.region AS other, count(*) AS shared FROM m a JOIN m b USING (cycle) WHERE a.region <> b.region GROUP BY 1, 2)
        SELECT region, other, shared, row_number() OVER (PARTITION BY region ORDER BY shared DESC, other) AS rank, round(shared / cycles::double + 1e-10, 6) AS share FROM shared JOIN size USING (region) QUALIFY rank <= 3"""),
    "merged_analyses": (merged_analyses, _FE + "SELECT segstr, round(avg(preval) + 1e-10, 6) AS preval, round(avg(ord) + 1e-10, 6) AS ord, string_agg(DISTINCT concat('g', l_orderkey % 5), ',' ORDER BY concat('g', l_orderkey % 5)) AS genes FROM flow_edges GROUP BY segstr"),
    "allelic_variance": (allelic_variance, "SELECT half, count(*) AS n, round(var_pop(CASE WHEN half = 1 THEN o_totalprice / 1000 ELSE o_custkey / 100.0::double END), 3) AS variance FROM (SELECT *, ntile(2) OVER (ORDER BY o_orderkey) AS half FROM orders) t GROUP BY half"),
    "regression_fit": (regression_fit, "SELECT l_returnflag, round(regr_slope(l_discount, l_quantity) + 1e-10, 6) AS slope, round(regr_intercept(l_discount, l_quantity) + 1e-10, 6) AS intercept, round(regr_r2(l_discount, l_quantity) + 1e-10, 6) AS r2, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
}
