"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments.  If two fingerprints differ in at
most four bits, some segment differs in at most one (three segments with two or more
differing bits each would need six).  The index therefore holds, for each segment,

* the segment itself (pairs that agree on it), and
* one variant per bit with that bit replaced by a wildcard (pairs that differ in
  exactly that bit).

Pairs come from equality joins on these keys and are verified with a popcount; links
become groups by large-star / small-star contraction.

Only *distinct* fingerprints enter the index, so exact copies cost one row.  A key
held by more than ``BLOCK`` fingerprints (a large group of near copies) is dealt out
as pairs of blocks of bounded size; each block pair returns a spanning forest of its
links instead of all of them, which keeps every component and never emits all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import fresh_name, map_batches, materialize, with_row_ids

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: (first bit, width) of the three segments, from the least significant bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most fingerprints of one index key that are joined as plain pairs; also the block size beyond.
BLOCK = 256


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a whole text.

    Words are runs of characters other than ASCII white space after lower-casing A-Z;
    features are the XXH64 hashes of their 4-word shingles, repeats included.  Fewer than
    four words form one shingle.  Null, empty or white-space-only text gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 1:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE_WORDS - 1 :].tolist())), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        votes += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, in the rows' own partitions."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {kind}, fp bigint")


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _index(fps: DataFrame) -> DataFrame:
    """(key, side, fp): three exact keys and 64 one-wildcard keys of each fingerprint.

    ``side`` is 0 or 1 for a wildcard bit's value, so that only pairs differing in that
    bit meet, and -1 for an exact key.  A pair meets at most once per segment.
    """
    keys = []
    for s, (first, width) in enumerate(SEGMENTS):
        seg = _segment(F.col("fp"), first, width)
        tag = s << 32
        keys.append(F.struct(seg.bitwiseOR(F.lit(tag)).alias("key"), F.lit(-1).cast("tinyint").alias("side")))
        for bit in range(width):
            free = seg.bitwiseAND(F.lit(~(1 << bit) & ((1 << width) - 1)))
            keys.append(F.struct(free.bitwiseOR(F.lit(tag | ((bit + 1) << 24))).alias("key"), F.shiftright(seg, bit).bitwiseAND(F.lit(1)).cast("tinyint").alias("side")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.side", "fp")


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sets of fingerprints (indices into ``fps``)."""
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in left.tolist():
        near = right[np.bitwise_count(fps[right] ^ fps[i]) <= MAX_BITS]
        a = root(i)
        for j in near.tolist():
            b = root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group (a pair of blocks of one key), at most 2 * BLOCK-sized, to its forest."""
    table = pa.Table.from_batches(list(batches))
    fps = table.column("fp").to_numpy().view(np.uint64)
    side, block = table.column("side").to_numpy(), table.column("block").to_numpy()
    bi, bj, key_side = table.column("bi")[0].as_py(), table.column("bj")[0].as_py(), side[0]
    if key_side < 0:
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    else:
        left, right = np.flatnonzero((block == bi) & (side == 0)), np.flatnonzero((block == bj) & (side == 1))
    pairs = _forest(fps, left, right)
    signed = fps.view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(signed[[i for i, _ in pairs]], pa.int64()), pa.array(signed[[j for _, j in pairs]], pa.int64())], names=["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """(u, v) pairs of distinct fingerprints at ``MAX_BITS`` or fewer differing bits: all
    of those between keys of usual size, a spanning forest of each block pair in hot keys."""
    index = _index(fps)
    # keys that a large group of near copies shares; usually none
    crowded = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "crowded-keys")
    usual, hot = index.join(crowded, "key", "left_anti"), index.join(crowded, "key")
    a = usual.where("side <> 1").select("key", "side", F.col("fp").alias("u"))
    b = usual.where("side <> 0").select("key", F.col("side").alias("other"), F.col("fp").alias("v"))
    meet = ((F.col("side") == 0) & (F.col("other") == 1)) | ((F.col("side") == -1) & (F.col("other") == -1) & (F.col("u") < F.col("v")))
    # Spark takes an exploded table for no larger than what it came from, and would broadcast all keys
    a, b = a.hint("merge"), b.hint("merge")
    pairs = a.join(b, (a["key"] == b["key"]) & meet & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = hot.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("m", blocks)
    # a block meets each other one: of an exact key once, of a wildcard key as the side that its bit tells
    met = F.expr("""transform(sequence(0, m - 1), x -> CASE side WHEN 0 THEN struct(block AS bi, x AS bj) WHEN 1 THEN struct(x AS bi, block AS bj)
        ELSE struct(least(x, block) AS bi, greatest(x, block) AS bj) END)""")
    dealt = hot.select("key", "side", "fp", "block", F.explode(met).alias("p")).select("key", "side", "fp", "block", "p.bi", "p.bj")
    forests = dealt.groupBy("key", "bi", "bj").applyInArrow(lambda t: _group(t), "u bigint, v bigint")
    return pairs.unionByName(forests)


def _group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_forests(iter(table.to_batches()))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most four bits,
    the document itself included.  Texts without words share fingerprint zero and are
    linked like any others.  Repeated rows give repeated results; a null doc_id never
    names a component unless all its members are null.  An empty table gives no rows.
    """
    marked = materialize(with_fingerprint(docs, id_col, text_col), "fingerprints")
    lowest = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    root = components(links(lowest.select("fp"))).withColumnRenamed("component", "root")
    grouped = lowest.join(root, lowest["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    # written, so that the last plan, which the driver holds whole, is a join or two
    label = materialize(grouped.join(named, "root").select("fp", "component_id"), "labels")
    return marked.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each near-duplicate group: that of its smallest doc_id
    (null ids last), and of rows that repeat it, one."""
    row = fresh_name(docs, "row")
    rows = with_row_ids(docs, row)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = near_duplicates(rows.select(name.alias("doc_id"), "text"))
    kept = found.where("doc_id.row = component_id.row").select(F.col("doc_id.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
