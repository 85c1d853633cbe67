"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays whole.  A group larger than a shard's
fair share cannot, so it is cut into pieces (by row, whatever the ids) before balancing.
Groups heavy enough to matter are balanced one by one; there are at most ``ATOMS`` of
them because each holds at least 1/ATOMS of all bytes.  The others are gathered in
``ATOMS`` hash buckets.  So the driver differences at most a few times ``ATOMS`` sums,
whatever the size of the table.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Hash buckets of small groups, and the share of all bytes from which a group counts alone.
ATOMS = 4096
#: Rows, about, that one numbering task sorts.
ROWS_PER_BUCKET = 50_000


def karmarkar_karp(sizes: list[int], parts: int) -> list[int]:
    """The part of each size: repeatedly combine the two partial partitions of largest
    spread, the fullest parts of one with the emptiest of the other."""
    if not sizes:
        return []
    heap = []
    for i, size in enumerate(sizes):
        sums = [(0, [])] * (parts - 1) + [(size, [i])]
        heapq.heappush(heap, (-size, i, sums))
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        merged = sorted(((x + y, [u, v]) for (x, u), (y, v) in zip(a, reversed(b))), key=lambda s: s[0])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], min(i, j), merged))
    where = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            for x in stack.pop():
                if isinstance(x, list):
                    stack.append(x)
                else:
                    where[x] = part
    return where


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1; a null text has none and counts as empty, and is
    grouped apart from empty texts.  Slots number each shard's rows from 0 without gaps.
    Repeated rows and null ids take a slot each, and a large group of them is cut like any other;
    texts of any length count by their bytes alone; an empty table gives no rows.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("")).alias("group"),
            # written, so that a row keeps its number
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    fair = max(total // shards, 1)
    # at most ATOMS rows: each holds 1/ATOMS of all bytes
    heavy = {r["group"]: r["bytes"] for r in groups.where(F.col("bytes") * ATOMS >= F.lit(total)).collect()} if total else {}
    pieces = {g: (-(-8 * n // fair) if n > fair else 1) for g, n in heavy.items()}
    spark = docs.sparkSession
    heavy_df = spark.createDataFrame([(g, p) for g, p in pieces.items()], "group string, pieces int")
    atom = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(ATOMS)).cast("string"))).otherwise(F.concat_ws("/", F.col("group"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("pieces")).cast("string")))
    marked = rows.join(F.broadcast(heavy_df), "group", "left").select("doc_id", "size", "text_crc32", "row", atom.alias("atom"))
    # at most ATOMS buckets, ATOMS heavy groups and 9 pieces of each of the few beyond a fair share
    sums = sorted((r["atom"], r["bytes"]) for r in marked.groupBy("atom").agg(F.sum("size").alias("bytes")).collect())
    part = karmarkar_karp([n for _, n in sums], shards)
    placed = marked.join(F.broadcast(spark.createDataFrame([(a, p) for (a, _), p in zip(sums, part)], "atom string, shard int")), "atom")
    return number(placed.select("doc_id", "size", "text_crc32", "row", F.lit("bytes").alias("law"), "shard")).withColumn("grown_shard", F.lit(None).cast("int"))


def number(placed: DataFrame) -> DataFrame:
    """Add ``slot``: within each shard, hash buckets follow one another and rows are
    numbered inside a bucket, so that no task sorts a whole shard, nor all rows of one id."""
    placed = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(1 << 16))), "shard-placed")
    buckets = max(1, min(1 << 16, placed.count() // ROWS_PER_BUCKET))
    placed = placed.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    # at most 65536 counts a shard
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row"))
    numbered = placed.withColumn("inside", inside)
    return numbered.join(counts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("inside") - 1 + F.col("before")).cast("long").alias("slot"))
