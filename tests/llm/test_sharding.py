import itertools
import random
import zlib

from lineagelake.llm import sharding


def test_differencing_is_tight():
    r = random.Random(1)
    sizes = [r.randrange(1, 1000) for _ in range(500)]
    part = sharding.karmarkar_karp(sizes, 7)
    sums = [sum(s for s, p in zip(sizes, part) if p == k) for k in range(7)]
    assert max(sums) - min(sums) <= 2 and sharding.karmarkar_karp([], 3) == []
    assert sorted(sharding.karmarkar_karp([5], 3)) == [sharding.karmarkar_karp([5], 3)[0]]


def check(spark, rows, shards=16):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, pieces int")
    got = sharding.shard_by_bytes(df, shards).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for k in range(shards):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in got)
    return got


def test_groups_stay_whole_and_sizes_near_equal(spark):
    r = random.Random(2)
    rows = [(k, "é" * r.randrange(1, 60) + str(k // 2)) for k in range(3000)] + [(5000, None), (5001, ""), (None, "null"), (7, "again"), (7, "again")]
    got = check(spark, rows)
    sums = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 16
    text = dict((i, t) for i, t in rows if i is not None and i < 3000 and i != 7)
    where = {}
    for x in got:
        if x.doc_id in text:
            where.setdefault(text[x.doc_id], set()).add(x.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_of_a_third_is_cut(spark):
    rows = [(k, "hot text") for k in range(3000)] + [(10_000 + k, f"text {k:04d}") for k in range(6000)]
    got = check(spark, rows)
    sums = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert max(sums) - min(sums) <= 0.05 * sum(sums) / 16


def test_few_rows_and_none(spark):
    assert len(check(spark, [(1, "one")])) == 1
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_differencing_equals_a_plain_version():
    """Two parts: repeatedly replace the two largest numbers by their difference; what stays is the spread."""
    r = random.Random(4)
    for n in range(1, 12):
        sizes = [r.randrange(1, 100) for _ in range(n)]
        left = sorted(sizes)
        while len(left) > 1:
            a, b = left.pop(), left.pop()
            left = sorted([*left, a - b])
        part = sharding.karmarkar_karp(sizes, 2)
        assert abs(sum(s if p else -s for s, p in zip(sizes, part))) == left[0]


def test_near_the_best_partition_of_few_sizes():
    r = random.Random(5)
    for _ in range(20):
        sizes = [r.randrange(1, 50) for _ in range(7)]
        top = lambda part: max(sum(s for s, p in zip(sizes, part) if p == k) for k in range(3))
        best = min(map(top, itertools.product(range(3), repeat=7)))
        assert top(sharding.karmarkar_karp(sizes, 3)) <= 1.25 * best


def test_a_hot_group_without_ids_is_cut(spark):
    rows = [(None, "hot text") for _ in range(3000)] + [(10_000 + k, f"text {k:04d}") for k in range(6000)]
    got = check(spark, rows)
    sums = [sum(x.size for x in got if x.shard == k) for k in range(16)]
    assert max(sums) - min(sums) <= 0.05 * sum(sums) / 16


def test_a_very_long_text(spark):
    got = check(spark, [(1, "é" * 2_000_000), (2, "a"), (2, "a"), (3, None)], shards=2)
    assert next(r.size for r in got if r.doc_id == 1) == 4_000_001
