import random

import pytest

from lineagelake.sources import writers


def plain(rows):
    """Newick text of every tree, by a walk from its root; iterative, so a long path is no matter."""
    ratio, parent = {e: r for e, _, r in rows}, {e: p for e, p, _ in rows}
    below = {}
    for e, p, _ in sorted(rows):
        below.setdefault(p if p in ratio else None, []).append(e)
    out = {}
    for top in below.get(None, []):
        done, stack = {}, [(top, False)]
        while stack:
            e, ready = stack.pop()
            leaf = f"{e}:{ratio[e]:f}"
            if not ready:
                stack.append((e, True))
                stack += [(c, False) for c in below.get(e, [])]
                continue
            inner = [done.pop(c) for c in below.get(e, [])] + ([leaf] if e in below else [leaf, "n" + leaf])
            done[e] = f"({','.join(inner)}):{ratio.get(parent[e], 1.0) - ratio[e]:f}"
        out[top] = done[top] + ";"
    return out


def texts(found):
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1]))
    out = {}
    for root, place, piece in rows:
        assert place == len(out.setdefault(root, []))
        out[root].append(piece)
    return {root: "".join(p) for root, p in out.items()}


def test_newick(spark):
    rows = [(1, None, 0.75), (2, 1, 0.5), (3, 1, 0.25)]
    assert texts(writers.newick(spark.createDataFrame(rows, "event int, parent int, ratio double"))) == {1: "((2:0.500000,n2:0.500000):0.250000,(3:0.250000,n3:0.250000):0.500000,1:0.750000):0.250000;"}


def test_many_trees(spark, tmp_path):
    """Random trees, a star, a path of 60 events, single events, an unknown parent and repeated rows, and their files."""
    r, rows = random.Random(3), []
    for t in range(20):
        ids = r.sample(range(1000 * t, 1000 * t + 999), r.randrange(1, 25))
        rows += [(e, r.choice(ids[:k]) if k else r.choice([None, 999_999]), r.randrange(64) / 64) for k, e in enumerate(ids)]
    rows += [(50_000, None, 0.5)] + [(50_001 + k, 50_000, 0.25) for k in range(100)]
    rows += [(60_000 + k, 60_000 + k - 1 if k else None, 1 - k / 320) for k in range(60)]
    tree = spark.createDataFrame(rows + rows[:3] + [(None, 1, 0.5)], "event int, parent int, ratio double").repartition(3)
    want = plain(rows)
    assert texts(writers.newick(tree)) == want
    writers.write_newick(tree, str(tmp_path / "trees"))
    parts = sorted((tmp_path / "trees").glob("part-*"))
    assert "".join(p.read_text().replace("\n", "") for p in parts) == "".join(want[k] for k in sorted(want))


def test_no_tree(spark):
    empty = spark.createDataFrame([], "event int, parent int, ratio double")
    assert writers.newick(empty).count() == 0
    with pytest.raises(ValueError):
        writers.newick(spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (3, None, 0.1)], "event int, parent int, ratio double"))
