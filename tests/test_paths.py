import random

from lineagelake.operators import paths


def walk(edges, origin, value, blocked):
    """Both distances of every node by a queue over one small graph."""
    near = {}
    for u, v, f in edges:
        if abs(f) > paths.LEAST_FLOW:
            near.setdefault((u, f > 0), set()).add(v)
            near.setdefault((v, f > 0), set()).add(u)
    even, odd, todo = {origin: 0}, {}, [origin]
    while todo:
        node = todo.pop(0)
        for one in near.get((node, not value > 0), ()):
            if node == origin and one == blocked or one in odd:
                continue
            odd[one] = even[node] + 1
            for two in near.get((one, value > 0), ()):
                if two not in even:
                    even[two] = even[node] + 1
                    todo.append(two)
    return {n: (even.get(n), odd.get(n)) for n in set(even) | set(odd)}


def test_equals_a_queue_from_each_origin(spark):
    r = random.Random(9)
    edges = [(r.randrange(40), r.randrange(40), r.choice([-2.0, -0.5, 0.0, 1e-4, 0.5, 3.0])) for _ in range(90)] + [(100 + k, 101 + k, (-1.0) ** k) for k in range(30)] + [(0, k, -1.0) for k in range(40, 60)]
    origins = [(k, r.randrange(40), r.choice([-1.0, 1.0, 0.0]), r.choice([None, r.randrange(40)])) for k in range(12)] + [(50, 100, -1.0, None), (51, 100, 1.0, None), (52, 777, 1.0, None)]
    got = paths.alternating_distances(spark.createDataFrame([*edges, (None, 1, 1.0), (1, 2, None)], "u int, v int, flow double").repartition(3), spark.createDataFrame(origins + origins[:2], "source int, origin int, value double, blocked int"))
    found = {}
    for s, n, e, o in got.collect():
        assert (s, n) not in found
        found[s, n] = (e, o)
    want = {(s, n): d for s, o, v, b in origins for n, d in walk(edges, o, v, b).items()}
    assert found == want and found[52, 777] == (0, None) and max(e or 0 for e, _ in found.values()) > 10


def test_without_edges(spark):
    origins = spark.createDataFrame([(1, 5, 1.0, None)], "source int, origin int, value double, blocked int")
    edges = spark.createDataFrame([], "u int, v int, flow double")
    assert [tuple(r) for r in paths.alternating_distances(edges, origins).collect()] == [(1, 5, 0, None)]
    assert paths.alternating_distances(edges, origins.limit(0)).count() == 0
