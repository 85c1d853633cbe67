"""Operators against brute force and against the invariants they promise."""

import random

import pytest
from pyspark.sql import functions as F

from lineagelake.functions import cycles
from lineagelake.operators import events, graph, intervals, sampling
from lineagelake.sources import writers


def random_intervals(seed, n, span=5000, longest=400):
    r = random.Random(seed)
    out = []
    for k in range(n):
        a = r.randrange(span)
        out.append((r.choice("ab"), a, a + r.randrange(longest), k))
    return out


@pytest.mark.parametrize("width", [50, 1000])
def test_overlap_join(spark, width):
    a, b = random_intervals(1, 120), random_intervals(2, 120)
    left = spark.createDataFrame(a, "chrom string, start long, finish long, i long")
    right = spark.createDataFrame(b, "chrom string, r_start long, r_finish long, j long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(left, right, width).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1])


def test_merge_and_elementary(spark):
    rows = random_intervals(3, 60)
    df = spark.createDataFrame(rows, "chrom string, start long, finish long, i long")
    covered = {(c, p) for c, s, f, _ in rows for p in range(s, f + 1)}
    merged = intervals.merge_overlapping(df).collect()
    assert {(r.chrom, p) for r in merged for p in range(r.start, r.finish + 1)} == covered
    assert sum(r.n for r in merged) == len(rows)
    for r in intervals.elementary(df).collect():
        for p in (r.start, (r.start + r.finish) // 2):
            assert r.depth == sum(c == r.chrom and s <= p < f for c, s, f, _ in rows)


def test_asof_and_points(spark):
    rows = random_intervals(4, 40)
    points = [(random.Random(k).choice("ab"), random.Random(k).randrange(5500), k) for k in range(80)]
    p = spark.createDataFrame(points, "chrom string, pos long, k long")
    b = spark.createDataFrame(rows, "chrom string, r_start long, r_finish long, i long")
    got = {r.k: r.i for r in intervals.asof_finish(p, b).collect()}
    inside = {r.k: r.i for r in intervals.points_in_intervals(p, b, 100).collect()}
    for c, pos, k in points:
        later = sorted((f, s, i) for ch, s, f, i in rows if ch == c and f >= pos)
        assert got[k] == (later[0][2] if later and later[0][1] <= pos else None)
        hit = sorted((s, f, i) for ch, s, f, i in rows if ch == c and s <= pos <= f)
        assert inside.get(k) == (hit[0][2] if hit else None)


def test_gap_fillers_follow_the_rule(spark):
    df = spark.createDataFrame([("1", 10, 20), ("2", 10, 20), ("2", 2000, 3000), ("2", 6000, 7000)], "chrom string, start long, finish long")
    got = sorted((r.chrom, r.start, r.finish) for r in intervals.gap_fillers(df).collect())
    assert got == [("2", 20, 1020), ("2", 3000, 4000), ("2", 4000, 5000)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "chrom string, start long, finish long")
    assert intervals.merge_overlapping(none).count() == 0
    assert intervals.elementary(none).count() == 0
    occ = spark.createDataFrame([], "history_id long, segstr string, cnval int, preval double, ord int")
    stats = spark.createDataFrame([], "history_id long, upper_cost int, lower_cost int")
    assert events.likelihood(occ, stats).count() == 0
    assert events.run_counts(occ).count() == 0


def test_likelihood_masks_zero_costs(spark):
    occ = spark.createDataFrame([(0, "s", 1), (1, "s", 1), (1, "s", 1), (2, "t", 1)], "history_id long, segstr string, cnval int")
    stats = spark.createDataFrame([(0, 0, 0), (1, 2, 2), (2, 0, 4), (3, 1, 1)], "history_id long, upper_cost int, lower_cost int")
    got = {r.segstr: (r.numhists, r.likelihood) for r in events.likelihood(occ, stats).collect()}
    assert got == {"s": (2, 0.5), "t": (1, 0.5)}  # history 0 has no cost; 2 counts above, not below


def test_split_duplicates(spark):
    occ = spark.createDataFrame([(1, "s", 1, 0.5, 1), (1, "s", 1, 0.2, 2), (1, "s", 1, 0.9, 3), (2, "s", 1, 0.1, 1)], "history_id long, segstr string, cnval int, preval double, ord int")
    assert {(r.history_id, r.preval): r["copy"] for r in events.split_duplicates(occ).collect()} == {(1, 0.9): 0, (1, 0.2): 1, (1, 0.5): 2, (2, 0.1): 0}


@pytest.mark.parametrize("values, kind", [([], 3), ([-1.0], 1), ([1.0, 2.0], 2), ([-1.0, 1.0], 4), ([-1.0, 1.0, 1.0], 2), ([0.0], 4)])
def test_event_type(spark, values, kind):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(cycles.event_type(F.col("v")).alias("t")).first().t == kind


def test_cycle_text_round_trip(spark):
    text = "chr1:5(+)-chr2:9(-),chr1:10-20"
    df = spark.createDataFrame([(text, 1.5)], "t string, v double").withColumn("e", cycles.parse_cycle(F.col("t"), F.col("v")))
    r = df.select(cycles.cycle_text(F.col("e")).alias("t"), cycles.segment_length(F.col("e")).alias("n"), "e.value", cycles.start_at(F.col("e"), F.lit(1)).alias("s")).first()
    assert (r.t, r.n, r.value, [x.is_adj for x in r.s]) == (text, 11, [1.5, -1.5], [False, True])


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)]
    found = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    assert found == {n: root(n) for n in parent}


def test_components_read_their_edges_once(spark, tmp_path):
    """Loops are told from the written edges: the result does not run again what made them."""
    spark.createDataFrame([(1, 2), (3, 3), (3, 3), (2, 2), (None, 4), (5, None)], "u long, v long").write.parquet(str(tmp_path / "edges"))
    found = graph.components(spark.read.parquet(str(tmp_path / "edges")))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 3)]
    assert not any("edges" in f.rsplit("/", 2)[-2] for f in found.inputFiles())


def test_poisson_mixture(spark):
    import numpy as np

    x = np.concatenate([np.random.default_rng(1).poisson(3, 3000), np.random.default_rng(2).poisson(20, 1000)])
    found, _ = sampling.poisson_mixture(spark.createDataFrame([(int(v),) for v in x], "count int"))
    assert found[0][1] == pytest.approx(3, abs=0.2) and found[1][1] == pytest.approx(20, abs=0.6)
    assert found[0][0] == pytest.approx(0.75, abs=0.03)


def test_partial_order(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "before long, after long")
    assert {r.element: r.depth for r in sampling.topological_depth(df).collect()} == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        sampling.topological_depth(df.union(spark.createDataFrame([(3, 1)], df.schema)))


@pytest.mark.parametrize("span, share", [(5000, 0.5), (200_000, 0.1), (1000, 0.02)])
def test_germline_fold_streams_the_plain_loop(spark, span, share):
    r = random.Random(span)
    rows = [(c, s, f, r.random() < share, k) for c, s, f, k in random_intervals(span, 400, span)]
    want, kept, last = [], {}, {}
    meets = lambda x, o: o is not None and x[1] < o[2] and x[2] > o[1]
    for x in sorted(rows, key=lambda x: (x[1], x[2], x[4])):
        mine = kept.setdefault(x[0], [])
        if x[3]:
            if mine and meets(x, mine[-1]):
                mine.pop()
            last[x[0]] = x
        elif not meets(x, last.get(x[0])):
            mine.append(x)
    want = sorted((x[0], x[1], x[2], x[4]) for mine in kept.values() for x in mine)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sampling.germline_fold(spark.createDataFrame(rows, "chrom string, start long, finish long, germline boolean, call_id long"))
        assert want and sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # no task holds a chromosome


def test_repeated_points_are_answered_each(spark):
    points = spark.createDataFrame([("c", 5), ("c", 5), ("c", 50)], "chrom string, pos long")
    found = intervals.points_in_intervals(points, spark.createDataFrame([("c", 1, 9, 7), ("c", 2, 8, 6)], "chrom string, r_start long, r_finish long, i int"))
    assert sorted((r.pos, r.i) for r in found.collect()) == [(5, 7), (5, 7)]


def absorbed(rows, least=5):
    """The rule in plain steps: rows (start, finish, marks, mean) of one chromosome."""
    cells = [dict(start=a, finish=z, marks=n, mean=m, soft=None) for a, z, n, m in rows]
    kept = []
    size = lambda c: c["finish"] - c["start"] + 1
    for k, c in enumerate(cells):
        if c["marks"] < least and kept:
            last = kept[-1]
            last["mean"] = (last["mean"] * size(last) + c["mean"] * size(c) / 2) / (size(last) + size(c) // 2)
            last["finish"] = c["finish"]
            last["marks"] += c["marks"] // 2
        else:
            kept.append(c)
        if c["marks"] < least and k + 1 < len(cells):
            n = cells[k + 1]
            n["mean"] = (c["mean"] * size(c) / 2 + n["mean"] * size(n)) / (size(c) // 2 + size(n))
            n["start"] = c["start"] if c["soft"] is None else (c["start"] + c["soft"]) // 2
            n["soft"] = c["finish"]
            n["marks"] += c["marks"] // 2
    return [(c["start"], c["finish"], c["marks"], round(c["mean"], 9)) for c in kept]


def test_absorbing_equals_plain_steps(spark):
    import random

    r = random.Random(11)
    rows, want = [], {}
    for k in range(40):
        at, cells = 0, []
        for _ in range(r.randrange(1, 9)):
            end = at + r.randrange(1, 40)
            cells.append((at, end, r.randrange(1, 12), float(r.randrange(1, 5))))
            at = end + 1
        rows += [("s", f"c{k}", *c) for c in cells]
        want[f"c{k}"] = absorbed(cells)
    got = {}
    for x in sampling.absorb_small(spark.createDataFrame(rows, "sample string, chrom string, start long, finish long, num_marks long, mean double")).collect():
        got.setdefault(x.chrom, []).append((x.start, x.finish, x.num_marks, round(x["mean"], 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
