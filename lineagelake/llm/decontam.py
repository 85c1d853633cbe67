"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is *contained* in a document if the document holds at least ``THRESHOLD`` of the
item's distinct shingles (``SHINGLE_WORDS`` words, lower-cased).  Items are partitioned by
the size of their shingle set: partition p holds those of 2**p to 2**(p+1) - 1.  The partition's
upper size bound gives the most shingles that a document may miss of any of its items; the
partition's items are indexed by bottom-k MinHash sketches of that many plus ``needed_hits`` shingles.  A
document that contains an item therefore meets at least ``needed_hits`` of its sketch,
however long the document is; one that meets fewer of a partition is no candidate there.  (Banded
MinHash over whole documents cannot: a 40-word item in a 20,000-word document has
Jaccard similarity 0.002.)

One pass over the documents hashes their shingles and looks them up in the partitions' sketches.
A candidate returns the shingles that it shares with its partitions' items; an equality join
with the items then estimates by the sketches and verifies exactly, by the shingles themselves.

The index of item hashes is broadcast while it has at most ``MAX_BROADCAST`` rows; beyond, the documents'
shingles meet the items in a shuffled join and the rules are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, map_batches, materialize, with_row_ids

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Most item hashes that are broadcast (20 bytes each with the bitmap before them).
MAX_BROADCAST = 1 << 22
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """Shingle hashes of texts: a polynomial hash of each word's lower-cased bytes, taken from
    running sums, mixed over each run of words.  Hashes only find; shingles verify."""

    STEP = 1 << 20  # bytes hashed at once

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.size = words
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\v\f\r")] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base, n = int(_MIX[0]), max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))
                self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64))))

    def word_hashes(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        out, at = [], 0
        while at < len(data):
            end = min(at + self.STEP, len(data))
            while end < len(data) and not self.space[data[end]]:
                end += 1
            piece = np.frombuffer(data, np.uint8, end - at, at)
            blank = np.ones(len(piece) + 2, bool)
            blank[1:-1] = self.space[piece]
            edge = np.flatnonzero(blank[1:] != blank[:-1])
            self._powers(len(piece) + 1)
            run = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * self.power[: len(piece)], out=run[1:])
            out.append((run[edge[1::2]] - run[edge[::2]]) * self.inverse[edge[::2]])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        """One hash a shingle, in order; a text of fewer words has one shingle of them all."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        n = max(len(h) - self.size + 1, 1)
        out = np.full(n, min(self.size, len(h)), np.uint64)
        for j in range(min(self.size, len(h))):
            out = (out ^ h[j : j + n]) * _MIX[0]
            out ^= out >> np.uint64(29)
        out *= _MIX[1]
        return out ^ (out >> np.uint64(32))

    def shingle(self, words: list[bytes], at: int) -> bytes:
        return b" ".join(words[at : at + self.size])


def partition_of(shingles: int) -> int:
    return shingles.bit_length() - 1


def needed_hits(partition: int) -> int:
    """How many of an item's sketch a document must meet to be a candidate."""
    return max(1 << partition >> 2, 1)


def sketch_size(partition: int, threshold: float = THRESHOLD) -> int:
    """The partition's most missed shingles, by its upper size bound, and the hits needed beyond them;
    an item of fewer shingles is its own sketch."""
    most = (2 << partition) - 1
    return most - int(np.ceil(threshold * most - 1e-9)) + needed_hits(partition)


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, hash, shingle, q, partition, need, sketch): the distinct shingles of every item.

    ``sketch`` tells whether the shingle is among the item's smallest hashes, as many as its
    ``partition`` takes; a document that contains the item meets ``need`` of those.  Items
    without words have no rows.
    """
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                distinct = {shingler.shingle(words, k): int(h) for k, h in enumerate(shingler.hashes(text))}
                q = len(distinct)
                if not q:
                    continue
                p = partition_of(q)
                k = min(sketch_size(p, threshold), q)
                # of an item that is its own sketch, as many as the threshold asks for
                need = min(needed_hits(p), k - (q - int(np.ceil(threshold * q - 1e-9))))
                for place, (shingle, h) in enumerate(sorted(distinct.items(), key=lambda x: (x[1], x[0]))):
                    rows.append((i, h - (1 << 64) if h >> 63 else h, shingle, q, p, need, place < k))
            columns = list(zip(*rows)) or [()] * 7
            types = (b.schema.field(0).type, pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "hash", "shingle", "q", "partition", "need", "sketch"])

    return map_batches(items.select(F.col(id_col), F.col(text_col)), run, f"item_id {kind}, hash bigint, shingle binary, q int, partition int, need int, sketch boolean")


class Index:
    """Item hashes with the partitions they occur in, and those in whose sketches; a bitmap stands before them."""

    def __init__(self, hashes: np.ndarray, every: np.ndarray, sketch: np.ndarray, needs: dict[int, int]) -> None:
        order = np.argsort(hashes)
        self.hashes, self.every, self.sketch, self.needs = hashes[order], every[order], sketch[order], needs
        self.bits = max(int(32 * len(hashes)).bit_length(), 10)
        held = np.zeros(1 << self.bits, bool)
        held[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.bitmap = np.packbits(held, bitorder="little")

    def search(self, hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """Places of ``hashes`` that occur in an item of a partition for which the text is a
        candidate, and the bits of those partitions."""
        bit = hashes >> np.uint64(64 - self.bits)
        near = np.flatnonzero(self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
        near = near[np.unique(hashes[near], return_index=True)[1]]
        if not len(self.hashes) or not len(near):
            return near[:0], 0
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[near]
        near, at = near[same], at[same]
        candidate = sum(1 << p for p, need in self.needs.items() if (self.sketch[at] >> p & 1).sum() >= need)
        return near[self.every[at] & candidate != 0], candidate


def index_of(shingles: DataFrame) -> Index | None:
    """The index of ``item_shingles``; none if it has more than ``MAX_BROADCAST`` hashes."""
    bit = F.expr("shiftleft(1L, partition)")
    masks = shingles.groupBy("hash").agg(F.bit_or(bit).alias("every"), F.bit_or(F.when(F.col("sketch"), bit).otherwise(F.lit(0).cast("bigint"))).alias("sketch"))
    if masks.count() > MAX_BROADCAST:
        return None
    table = masks.toArrow()
    needs = {r["partition"]: r["need"] for r in shingles.groupBy("partition").agg(F.min("need").alias("need")).collect()}
    column = lambda c: table.column(c).to_numpy()
    return Index(column("hash").view(np.uint64), column("every"), column("sketch"), needs)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every pair at ``threshold`` or more.

    Null and empty texts, of either table, are in no pair.  An item of fewer than ``SHINGLE_WORDS`` words
    has one shingle, of them all, which only a document of just those words holds.  Rows that
    repeat a doc_id count as one document if any of them contains the item: the pair comes once,
    with the most shingles a single row shares.  Items that repeat an item_id with other texts are
    compared each on its own; the pair comes once, with the highest containment.  Texts are
    hashed a megabyte at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shingles = materialize(item_shingles(items.select(F.struct("item_id", F.monotonically_increasing_id().alias("copy")).alias("item_id"), "text"), threshold=threshold), "item-shingles")
    sent = docs.sparkSession.sparkContext.broadcast(index_of(shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        shingler = Shingler()
        for b in batches:
            row, hits, texts, masks = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                hashes = shingler.hashes(text)
                places, candidate = index.search(hashes) if index else (np.arange(len(hashes)), -1)
                if not len(places):
                    continue
                words = words_of(text)
                seen = {shingler.shingle(words, k): int(hashes[k]) for k in places.tolist()}
                row += [i] * len(seen)
                hits += [h - (1 << 64) if h >> 63 else h for h in seen.values()]
                texts += seen
                masks += [candidate] * len(seen)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), b.column(2).take(pa.array(row, pa.int64())), pa.array(hits, pa.int64()), pa.array(texts, pa.binary()), pa.array(masks, pa.int64())], names=["doc_id", "row", "hash", "shingle", "candidate"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    hits = map_batches(source, run, f"doc_id {kind}, row bigint, hash bigint, shingle binary, candidate bigint")
    # a partition's items meet only its candidates
    shared = hits.join(shingles, ["hash", "shingle"]).where(F.expr("shiftright(candidate, partition) & 1") == 1)
    pairs = shared.groupBy("row", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("q").cast("long").alias("n_item"), F.count_if("sketch").alias("met"), F.first("need").alias("need"))
    pairs = pairs.where((F.col("met") >= F.col("need")) & (F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)))
    best = pairs.groupBy("doc_id", F.col("item_id.item_id").alias("item_id")).agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, unchanged, of documents that contain no item; a null doc_id is judged like others."""
    row = fresh_name(docs, "row")
    rows = with_row_ids(docs, row)
    bad = contained(rows.select(row, "text"), items, id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*docs.columns)
