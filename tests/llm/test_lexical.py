import math
import random
import re
from collections import Counter

import pytest

from lineagelake.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in wanted.items():
        ranked = []
        for d, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                ranked.append((-s, d is None, d or 0, d))
        out += [(i, k, r[3], -r[0]) for k, r in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{int(r.expovariate(0.05))}" for _ in range(60)] + ["Ünï", "niño", "the", "THE", "x-y", "a_b", "日本"]
    return [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("max_terms", [lexical.MAX_TERMS, 0])
@pytest.mark.parametrize("bundle", [256, 3])
def test_against_a_plain_ranking(spark, monkeypatch, max_terms, bundle):
    """With the items' terms broadcast and joined, in one bundle and in several."""
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", bundle)
    docs, items = corpus(1, 300), corpus(2, 12)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), top=7, max_terms=max_terms)
    assert rows(got) == brute(docs, items, 7)


def test_short_ranges_and_ties(spark, monkeypatch):
    """Ranges of a few documents, and many equal scores at the cut, by ascending id."""
    monkeypatch.setattr(lexical, "RANGE_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    docs = [(i, "same words here" if i % 3 else f"other word{i}") for i in range(60)]
    items = [(1, "same words"), (2, "other"), (3, "nothing of it"), (4, "word3 word6 same")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string"), top=10)
    assert rows(got) == brute(docs, items, 10)


def test_odd_rows(spark):
    """Null and empty texts, null and repeated ids, items that repeat an id, very long texts, a clashing column."""
    docs = [(1, None), (2, ""), (3, "... !!"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "beta " * 200_000), (6, "Alpha"), (7, "gamma")]
    items = [(1, "alpha"), (1, "beta"), (None, "gamma"), (2, None), (3, ""), (4, "alpha")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, bundle string, score int")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, term string")
    assert rows(lexical.search(d, q)) == brute(docs, items, 50)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, empty):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    found = lexical.search(docs.limit(0) if empty != "items" else docs, items.limit(0) if empty != "docs" else items)
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_stages_hold_about_equal_postings():
    assert lexical.stage_of({0: 10, 1: 10, 2: 10, 3: 10}, 4) == {0: 0, 1: 1, 2: 2, 3: 3}
    assert lexical.stage_of({3: 1, 9: 100}, 4) == {3: 0, 9: 0}
    assert lexical.stage_of({}, 4) == {}
