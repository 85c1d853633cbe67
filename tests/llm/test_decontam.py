import math
import random

import pytest

from lineagelake.llm import decontam


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs, items):
    out = {}
    for d, t in docs:
        for i, x in items:
            q = shingles(x)
            n = len(q & shingles(t))
            if q and n >= math.ceil(0.8 * len(q) - 1e-9):
                out[d, i] = max(out.get((d, i), 0), n / len(q))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    items = [(k, text(r.choice([1, 3, 5, 6, 12, 30, 60]))) for k in range(40)] + [(50, None), (51, ""), (52, "a b"), (52, "another text of the same id"), (None, "null id item text of words")]
    docs = [(k, text(400)) for k in range(20)] + [(20, None), (21, ""), (22, "A\tB"), (23, "null ID item text of words")]
    for k, (i, x) in enumerate(items[:40]):
        w = (x or "").split()
        for _ in range(k % 4):  # some words changed
            w[r.randrange(len(w))] = "changed"
        docs.append((100 + k, f"{text(2000)} {' '.join(w)} {text(50)}"))
        docs.append((200 + k, " ".join(w)))
    docs.append((100, docs[0][1]))  # a repeated id
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, hash int, item_id string")
    got = {(p.doc_id, p.item_id): p.containment for p in decontam.contained(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 20


def test_every_container_is_a_candidate():
    """Whatever an item's shingles a document misses, as far as it may, enough of its sketch stays."""
    for q in range(1, 600):
        p = decontam.partition_of(q)
        assert 1 << p <= q < 2 << p
        k = min(decontam.sketch_size(p), q)
        missed = q - math.ceil(0.8 * q - 1e-9)
        assert k - missed >= min(decontam.needed_hits(p), k - missed) >= 1


def test_partitions_are_searched_apart(spark):
    """A document that meets a common shingle of many items, but no item's sketch often enough, returns nothing."""
    items = spark.createDataFrame([(k, "the same five common words " + " ".join(f"i{k}x{j}" for j in range(40))) for k in range(20)], "item_id long, text string")
    index = decontam.index_of(decontam.item_shingles(items))
    hashes = decontam.Shingler().hashes
    assert index.needs == {5: 8}
    assert len(index.search(hashes("here are the same five common words again"))[0]) == 0
    places, candidate = index.search(hashes("before it " + items.first().text + " and after"))
    assert candidate == 1 << 5 and len(places) == 41


def test_drop(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over", 1), (1, "something else", 2), (None, "the quick brown fox jumps over", 3), (2, None, 4)], "doc_id long, text string, row int")
    items = spark.createDataFrame([(9, "The quick brown fox jumps over")], "item_id long, text string")
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(x.row for x in left.collect()) == [2, 4]
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == 4
    assert decontam.contained(docs.limit(0), items).count() == 0


def test_long_text_in_slices():
    s = decontam.Shingler()
    text = " ".join(f"w{k % 977}" for k in range(20_000))
    whole = s.hashes(text)
    s.STEP = 1000
    assert (s.hashes(text) == whole).all()
