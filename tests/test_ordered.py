import random

import pytest
from pyspark.sql import functions as F

from lineagelake.operators.ordered import Fold, in_parts, running


def brute(rows, reverse):
    out = {}
    for k in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=reverse)
        values = []
        for g, o, v in group:
            known = [x for x in values if x is not None]
            out[o] = (sum(known) if known else None, len(known), max(known, default=None))
            values.append(v)
            known = [x for x in values if x is not None]
            xor = 0
            for x in known:
                xor ^= x
            out[o] += (xor if known else None, known[-1] if known else None, min(known, default=None))
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("keys", [1, 3, 200])
def test_equals_a_plain_loop(spark, keys, reverse):
    """Groups within a part, over several parts, and over all parts."""
    r = random.Random(keys)
    rows = [(r.choice([None, *range(keys)]), k, r.choice([None, r.randrange(100)])) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    v = F.col("v")
    folds = {"before": Fold("sum", v, own=False), "n": Fold("count", v, own=False), "high": Fold("max", v, own=False), "x": Fold("xor", v), "seen": Fold("last", v), "low": Fold("min", v)}
    got = running(in_parts(df, ["g"], ["o"]), ["g"], ["o"], folds, reverse)
    want = brute(rows, reverse)
    assert {x.o: (x.before, x.n, x.high, x.x, x.seen, x.low) for x in got.collect()} == {o: (w[0], w[1], w[2], w[3], w[4], w[5]) for o, w in want.items()}


def test_without_groups_and_without_rows(spark):
    df = spark.range(100).select(F.col("id").alias("o"))
    got = running(in_parts(df, [], ["o"]), [], ["o"], {"s": Fold("sum", F.col("o")), "before": Fold("last", F.struct("o"), own=False)}).collect()
    assert all(x.s == x.o * (x.o + 1) // 2 and (x.before.o if x.before else -1) == x.o - 1 for x in got) and len(got) == 100
    assert running(in_parts(df.limit(0), [], ["o"]), [], ["o"], {"s": Fold("sum", F.col("o"))}).count() == 0
