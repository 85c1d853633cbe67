import random

from pyspark.sql import functions as F

from lineagelake.functions import cycles

EDGES = f"k int, edges array<{cycles.EDGE}>"


def walk(points, adj=True):
    n = len(points)
    return [(adj, *points[i], "+", *points[(i + 1) % n], "-", 1.0) for i in range(n)]


def turned(edges):
    """The cycle read the other way."""
    return [(a, c2, e, s2, c, s, s1, v) for a, c, s, s1, c2, e, s2, v in reversed(edges)]


def test_equal_cycles_have_one_form(spark):
    r = random.Random(2)
    rows, group = [], {}
    for k in range(60):
        points = r.sample([(f"chr{c}", p) for c in (1, 2, 10) for p in range(1, 60)], r.randrange(3, 9))
        edges = walk(points)
        for _ in range(4):
            at = r.randrange(len(edges))
            same = edges[at:] + edges[:at]
            if r.random() < 0.5:
                same = turned(same)
            same = [tuple((e[0], e[4], e[5], e[6], e[1], e[2], e[3], e[7])) if r.random() < 0.5 else e for e in same]
            group[len(rows)] = k
            rows.append((len(rows), same))
    got = {x.k: x.t for x in spark.createDataFrame(rows, EDGES).select("k", cycles.cycle_text(cycles.canonical(F.col("edges"))).alias("t")).collect()}
    forms = {}
    for i, k in group.items():
        forms.setdefault(k, set()).add(got[i])
    assert all(len(f) == 1 for f in forms.values()) and len({next(iter(f)) for f in forms.values()}) == 60
    for t in got.values():  # each edge reads on from the one before, from the lowest point
        ends = [e.replace("(+)", "").replace("(-)", "").split("-") for e in t.split(",")]
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:] + ends[:1]))


def test_one_edge_and_a_cycle_that_does_not_meet(spark):
    lone = [(False, "chr2", 90, None, "chr1", 5, None, 1.0)]
    apart = [(True, "a", 5, "+", "a", 9, "-", 1.0), (True, "a", 1, "+", "a", 2, "-", 1.0), (True, "b", 5, "+", "b", 9, "-", 1.0)]
    got = {x.k: x.c for x in spark.createDataFrame([(1, lone), (2, apart)], EDGES).select("k", cycles.canonical(F.col("edges")).alias("c")).collect()}
    assert [(e.chrom, e.start, e.chrom2, e.end) for e in got[1]] == [("chr1", 5, "chr2", 90)]
    assert [(e.chrom, e.start) for e in got[2]] == [("a", 1), ("b", 5), ("a", 5)]


def plain_split(edges):
    """The rule in plain steps: cut the first place that comes back an even number of edges on; start again."""
    todo, done = [edges], []
    while todo:
        c = todo.pop()
        found = next(((b, a) for a in range(len(c)) for b in range(a) if (a - b) % 2 == 0 and c[a][1:3] == c[b][1:3]), None)
        if found:
            b, a = found
            todo += [c[b:a], c[:b] + c[a:]]
        else:
            done.append(c)
    return sorted(done)


def test_figure_eights_equal_plain_steps(spark):
    r = random.Random(3)
    rows = []
    for k in range(80):
        points = [("c", r.randrange(4)) for _ in range(r.randrange(1, 11))]
        rows.append((k, [(i % 2 == 0, *p, "+", "c", 100 + i, "-", float(i)) for i, p in enumerate(points)]))
    got = {x.k: sorted([tuple(e) for e in c] for c in x.c) for x in spark.createDataFrame(rows, EDGES).select("k", cycles.split_figure_eights(F.col("edges")).alias("c")).collect()}
    assert got == {k: plain_split(e) for k, e in rows} and any(len(c) > 2 for c in got.values())


def plain_merge(edges):
    e, i = [list(x) for x in edges], 0
    while i < len(e):
        here, before, after = e[i], e[i - 1], e[(i + 1) % len(e)]
        if len(e) > 2 and here[0] and here[1] == here[4] and abs(here[2] - here[5]) == 1 and not before[0] and not after[0]:
            ends = [before[2], before[5], after[2], after[5]]
            before[2], before[5] = min(ends), max(ends)
            e = [x for x in e if x is not here and x is not after]
        else:
            i += 1
    return [tuple(x) for x in e]


def test_merging_equals_plain_steps(spark):
    r = random.Random(4)
    rows = []
    for k in range(80):
        rows.append((k, [(i % 2 == 1 if r.random() < 0.9 else r.random() < 0.5, "c", (a := r.randrange(50)), "+", "c", a + r.choice([1, -1, 7]), "-", float(i)) for i in range(r.randrange(1, 9))]))
    got = {x.k: [tuple(e) for e in x.c] for x in spark.createDataFrame(rows, EDGES).select("k", cycles.merge_adjacent(F.col("edges")).alias("c")).collect()}
    assert got == {k: plain_merge(e) for k, e in rows}


def test_relations_of_edges(spark):
    a = (True, "c", 1, "+", "c", 10, "-", 1.0)
    cases = [((True, "c", 5, "+", "c", 20, "-", 1.0), (False, True, False, False)), ((True, "c", 10, "+", "c", 1, "-", 2.0), (True, False, True, False)), ((True, "c", 1, "+", "c", 10, "-", 9.0), (True, False, True, True)), ((True, "d", 5, "+", "d", 20, "-", 1.0), (False, False, False, False)), ((True, "c", 10, "+", "d", 3, "-", 1.0), (True, False, False, False))]
    df = spark.createDataFrame([(k, a, b) for k, (b, _) in enumerate(cases)], f"k int, a {cycles.EDGE}, b {cycles.EDGE}")
    x, y = F.col("a"), F.col("b")
    for r in df.select("k", cycles.connected(x, y).alias("p"), cycles.crosses(x, y).alias("q"), cycles.same_ends(x, y).alias("s"), cycles.same_place(x, y).alias("t")).collect():
        assert (r.p, r.q, r.s, r.t) == cases[r.k][1]
    assert spark.range(1).select(cycles.significant(F.lit(-0.2)).alias("v"), cycles.significant(F.lit(0.1)).alias("w")).first()[:] == (True, False)


def test_helpers(spark):
    edges = [(False, "c", 1, None, "c", 10, None, 1.0), (True, "c", 10, "+", "d", 4, "-", -1.0)]
    df = spark.createDataFrame([(1, edges)], EDGES)
    e = F.col("edges")
    r = df.select(cycles.reverse_cycle(e).alias("r"), cycles.alternate(F.array(F.lit(1), F.lit(1), F.lit(1)), F.lit(0.5)).alias("a"), cycles.touches(e, "d", 4, 9).alias("t"), cycles.touches(e, "c", 10, 20).alias("u"), cycles.touches(e, "x", 1, 2).alias("v"), cycles.edge_counts(e).alias("n"), cycles.strip_signs(F.lit("+c:1-2,-c:3-4")).alias("s"), cycles.floor_half(F.lit(-3)).alias("f"), cycles.half_away_from_zero(F.lit(-2.5)).alias("h")).first()
    assert [x.start for x in r.r] == [10, 1] and r.a == [0.5, -0.5, 0.5] and (r.t, r.u, r.v) == (True, True, False)
    assert (r.n.numsegs, r.n.numadjs, r.s, r.f, r.h) == (1, 1, "c:1-2,c:3-4", -2, -3.0)
