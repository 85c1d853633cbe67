import random

import numpy as np
import pytest

from lineagelake.operators import balance


def dense(carriers, holders, bonds, missing):
    """The normal equations of a small graph, solved whole.  carriers: {var: estimate}, holders: {node: var}."""
    merged = {}
    for u, v, f in bonds:
        key = (min(u, v), max(u, v))
        old = merged.get(key)
        f = None if f is None or f < 0 else f
        merged[key] = f if old is None else old if f is None else old + f
    names = list(carriers) + list(merged)
    nodes = sorted({n for uv in merged for n in uv} | set(holders))
    a = np.zeros((len(nodes), len(names)))
    for k, name in enumerate(names):
        if k >= len(carriers):
            for n in name:
                a[nodes.index(n), k] += 1
        else:
            for n, var in holders.items():
                if var == name:
                    a[nodes.index(n), k] = -1
    x = np.array(list(carriers.values()) + [f or 0.0 for f in merged.values()])
    d = np.array([1e6] * len(carriers) + [(0 if missing is None else missing**-2) if f is None else 1 / max(f, 10.0) ** 2 for f in merged.values()])
    c = np.linalg.lstsq(np.diag(d) + a.T @ a, a.T @ (-a @ x), rcond=1e-13)[0]
    return dict(zip(names, x + c))


def graph(seed, n=8):
    r = random.Random(seed)
    segments = [(2 * k, 2 * k + 1, r.choice([0.0, 5.0, 12.5, 40.0])) for k in range(n)]
    ends = [r.randrange(2 * n) for _ in range(30)]
    bonds = [(u, v, r.choice([None, -1.0, 0.0, 3.0, 30.0])) for u, v in zip(ends[::2], ends[1::2])] + [(3, 3, 4.0)]
    # of free bonds one between two nodes is enough, and none in a ring: those no numbers would determine
    seen, kept = {}, []
    for u, v, f in bonds:
        if f is None or f < 0:
            if seen.setdefault(u, u) != u or seen.setdefault(v, v) != v or u == v or (u in seen.get("used", set())) or (v in seen.get("used", set())):
                continue
            seen.setdefault("used", set()).update((u, v))
        kept.append((u, v, f))
    return segments, kept


@pytest.mark.parametrize("seed", [1])
def test_balance_equals_a_dense_solution(spark, seed):
    segments, bonds = graph(seed)
    rows = [(a, b, 0, f * 0.25) for a, b, f in segments] + [(b, a, 1, f * 0.75) for a, b, f in segments]
    got_segments, got_bonds = balance.balance(spark.createDataFrame(rows, "node int, twin int, phase int, flow double"), spark.createDataFrame(bonds, "u int, v int, flow double"))
    want = dense({f"s{a}": f for a, b, f in segments}, {n: f"s{a}" for a, b, _ in segments for n in (a, b)}, bonds, None)
    for r in got_bonds.collect():
        assert abs(r.flow - want[r.u, r.v]) < 1e-6
    flows = {(r.node, r.phase): r.flow for r in got_segments.collect()}
    for a, _, f in segments:
        assert abs(flows[a, 0] + flows[a, 1] - want[f"s{a}"]) < 1e-6
        if f > 0:
            assert abs(flows[a, 1] - 3 * flows[a, 0]) < 1e-6
        else:
            assert flows[a, 1] == 0


def test_chains_share_one_flow(spark):
    segments, bonds = graph(7)
    rows = [(a, b, f"c{k % 5}", 10.0 * (k + 1), f) for k, (a, b, f) in enumerate(segments)]
    chains, got = balance.balance_chains(spark.createDataFrame(rows, "node int, twin int, chain string, length double, flow double"), spark.createDataFrame(bonds, "u int, v int, flow double"))
    names = sorted({r[2] for r in rows})
    mean = {c: sum(r[4] * r[3] for r in rows if r[2] == c) / sum(r[3] for r in rows if r[2] == c) for c in names}
    want = dense(mean, {n: r[2] for r in rows for n in r[:2]}, bonds, balance.MISSING_DEVIATION)
    assert all(abs(r.flow - want[r.chain]) < 1e-6 for r in chains.collect()) and all(abs(r.flow - want[r.u, r.v]) < 1e-6 for r in got.collect())


def test_balanced_graph_stays(spark):
    """What balances is not touched, and a graph of nothing gives nothing."""
    segments = spark.createDataFrame([(0, 1, 0, 7.0), (2, 3, 0, 7.0)], "node int, twin int, phase int, flow double")
    bonds = spark.createDataFrame([(1, 2, 7.0), (3, 0, 7.0)], "u int, v int, flow double")
    a, b = balance.balance(segments, bonds)
    assert {r.flow for r in a.collect()} | {r.flow for r in b.collect()} == {7.0}
    a, b = balance.balance(segments.limit(0), bonds.limit(0))
    assert a.count() == b.count() == 0


def test_a_free_bond_takes_the_whole_error(spark):
    """A missing bond costs nothing: the nodes' errors vanish."""
    segments = spark.createDataFrame([(0, 1, 0, 10.0)], "node int, twin int, phase int, flow double")
    bonds = spark.createDataFrame([(0, 0, 4.0), (1, 1, None)], "u int, v int, flow double")
    a, b = balance.balance(segments, bonds)
    flow, bonds = a.first().flow, {r.u: r.flow for r in b.collect()}
    assert abs(2 * bonds[1] - flow) < 1e-8 and abs(flow - 10) < 1e-5
