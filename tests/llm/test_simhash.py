import random

import numpy as np
import pytest
import xxhash

from lineagelake.llm import simhash


def brute(texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    return [fp(t) for t in texts]


def components(ids, fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def variants(seed, n):
    r = random.Random(seed)
    base = [f"w{r.randrange(50)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_brute_force(spark):
    texts = [None, "", " \n\t", "One two", "one  TWO\n", "a b c", "a b c d", "ÉÀ é x", *variants(1, 40), *variants(2, 25), *[f"lone text number {k} " * 9 for k in range(20)]]
    ids = [*range(100, 100 + len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, key int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    fps = brute(texts)
    assert got == {(i, f"{f:016x}"): c for i, f, c in zip(ids, fps, components(ids, fps))}


def test_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # many keys hold more
    r = random.Random(3)
    fps = sorted({(0x123456789ABCDEF0 ^ sum(1 << b for b in r.sample(range(64), r.randrange(5)))) for _ in range(150)} | {r.getrandbits(64) for _ in range(30)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {x.node: x.component for x in simhash.components(simhash.links(df)).collect()}
    want = components(list(range(len(fps))), fps)
    groups = {}
    for f, c in zip(fps, want):
        s = int(np.uint64(f).astype(np.int64))
        groups.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_repeats_empty_and_keep_one(spark):
    df = spark.createDataFrame([(5, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 3), (3, "other words entirely different here", 4), (None, "a b c d e", 5), (None, None, 6)], "doc_id long, text string, row int")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect() if r.fingerprint != "0" * 16) == [(-1, 3), (3, 3), (3, 3), (3, 3), (5, 3)]
    kept = simhash.keep_one(df).collect()
    assert kept[0].__fields__ == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (3, "a b c d e"), (3, "other words entirely different here")]
    none = spark.createDataFrame([], df.schema)
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_any_spread_of_bits_is_found(spark, bits):
    r = random.Random(bits)
    pairs = [(f := r.getrandbits(64), f ^ sum(1 << b for b in r.sample(range(64), bits))) for _ in range(60)]
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    df = spark.createDataFrame([(signed(x),) for x in {y for p in pairs for y in p}], "fp long")
    found = {frozenset((x.u, x.v)) for x in simhash.links(df).collect()}
    assert all(a == b or frozenset((signed(a), signed(b))) in found for a, b in pairs)


def test_exploded_keys_are_not_broadcast(spark):
    """Spark takes the 67 keys of each fingerprint for as small as the fingerprint."""
    plan = simhash.links(spark.range(1000).selectExpr("xxhash64(id) AS fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key#" not in plan.split("SortMergeJoin [key")[0]
