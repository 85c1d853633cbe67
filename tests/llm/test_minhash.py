import random

import numpy as np
import pytest

from lineagelake.llm import minhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def brute(docs):
    """(doc_id, set size, smallest id reachable) of every row, by all pairs."""
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    low = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            low[root(k)] = min(low.get(root(k), d), d)
    return sorted(((d, len(sets[k]), low.get(root(k))) for k, (d, _) in enumerate(docs)), key=str)


def found(spark, docs):
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def corpus(seed, groups, size):
    """Groups of texts whose members drift from their base by 0 to 12 words, so that some link and some do not; a passage that all share."""
    r = random.Random(seed)
    passage, docs = " ".join(f"p{k}" for k in range(20)), []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice([12, 60, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(13) * len(base) // 150):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            docs.append(" ".join(words) + (" " + passage if r.random() < 0.5 else ""))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("groups,size", [(25, 8), (2, 100)])
def test_against_all_pairs(spark, groups, size):
    docs = corpus(groups, groups, size)
    want = brute(docs)
    assert found(spark, docs) == want
    assert 1 < len({w[2] for w in want}) < len(docs)


def test_links_between_blocks_and_homes(spark, monkeypatch):
    """Blocks of a few classes, the texts by a shuffled join: what no block holds by itself is found across."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "MAX_PLACES", 0)
    words, chain = [f"w{k}" for k in range(200)], []
    for k in range(30):  # each links with its neighbours in the chain, not with its ends
        chain.append(" ".join(words))
        for at in range(5):
            words[(k * 37 + at * 41) % 200] = f"y{k}_{at}"
    docs = list(enumerate(chain))
    random.Random(4).shuffle(docs)
    want = brute(docs)
    assert {w[2] for w in want} == {0} and found(spark, docs) == want


def test_a_group_that_links_is_not_dealt_out_in_pairs_of_blocks(spark, monkeypatch):
    """Near copies in many blocks: the blocks are joined by a few comparisons, not by comparing all of them with each other."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    dealt, compare = [], minhash._compare
    monkeypatch.setattr(minhash, "_compare", lambda rows, within: (dealt.append(rows.count()), compare(rows, within))[1])
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(160)]
    assert {c for _, _, c in found(spark, docs)} == {0}
    assert sum(dealt) < 12 * len(docs)


def test_odd_rows(spark):
    """Null, empty and blank texts, short texts, repeated and null ids, capitals, a long text, a clashing column."""
    long = " ".join(f"l{k}" for k in range(30_000))
    texts = [None, "", " \t\n", "one two", "ONE two", "one two three", "a b c d", "A b  c\nd", "a b c d e", long, long + " end", None]
    docs = list(enumerate(texts)) + [(3, "one two"), (None, "a b c d"), (None, "alone of its kind here"), (2, "one two three")]
    assert found(spark, docs) == brute(docs)
    clash = spark.createDataFrame([(d, t, "r", 1) for d, t in docs], "doc_id bigint, text string, row string, component_id int")
    got = minhash.near_duplicates(clash)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs) and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.near_duplicates(clash.limit(0)).count() == 0


def test_collections_and_bits():
    """Few minhashes make many tables, and two bits of each tell far from near."""
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 64, 1000, np.uint64)
    assert len(minhash.minhashes(pool)) == 96 == 2 * minhash.SIDE * minhash.GROUP
    share = lambda a, b: (minhash.minhashes(a) == minhash.minhashes(b)).mean()
    near, far = share(pool[:900], pool[100:]), share(pool[:550], pool[450:])
    assert abs(near - 0.8) < 0.15 and abs(far - 0.1) < 0.12


def test_chance_of_a_missed_link():
    """At the threshold: the two collections fail independently; above it they hardly can."""
    missed = lambda s: 2 * (1 - s**minhash.GROUP) ** minhash.SIDE
    assert missed(0.8) < 3e-5 and missed(0.9) < 1e-8
