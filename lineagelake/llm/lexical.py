"""Ranked lexical search by pipelined term partitioning.

The inverted index is partitioned by term: each owner stage holds the lists of a class of terms, rare
terms first, frequent ones last, with about equal postings a stage.  A list is cut by ranges of documents,
so a word that most documents hold is many short lists.  Items travel in bundles: a bundle and a range of
documents carry the sparse scores gathered so far to the next stage, where a cogroup brings them to the
lists of that stage's owner; integer contributions are added and the bundle moves on.  The last stage,
which holds most postings, adds up and selects at once, so its full scores are never shuffled.

No task holds more than a bundle's items times a range's documents.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, map_batches, materialize

TOP, STAGES = 50, 4
#: Documents of one range at most, and bytes of text from which it ends early.
RANGE_ROWS, RANGE_BYTES = 4096, 1 << 24
#: Items that travel together, about.
BUNDLE_ITEMS = 256
#: Most distinct terms of all items that are broadcast to the indexing tasks; beyond, the lists of all
#: terms are built and joined with the items' terms.
MAX_TERMS = 1 << 18
#: Bytes of terms: ASCII letters and digits, and all of characters beyond ASCII; A-Z lower-cased.
_TERM = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), distinct: rows that repeat an id make one item of all their terms."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t) for i, text in enumerate(b.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])

    return map_batches(items.select(F.col(id_col), F.col(text_col)), run, f"item_id {kind}, term binary").distinct()


def inverted(docs: DataFrame, vocabulary: frozenset[bytes] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lists of each range of documents: (range, term, offs, tfs, docs, lens).

    One row a range has a null term and the range's documents and lengths, documents without terms left
    out; the others have one term's offsets into them (16 bits) and occurrences (32 bits).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, number = sent.value, TaskContext.get().partitionId() << 24
        offs: dict[bytes, array] = {}
        tfs: dict[bytes, array] = {}
        ids: list[pa.Array] = []
        lens: list[int] = []
        id_type, size = pa.null(), 0

        def lists() -> pa.RecordBatch:
            names = list(offs)
            empty = [None] * len(names)
            held = pa.concat_arrays(ids)
            columns = [
                pa.array([number] * (len(names) + 1), pa.int64()), pa.array([None, *names], pa.binary()),
                pa.array([None, *(offs[t].tobytes() for t in names)], pa.binary()), pa.array([None, *(tfs[t].tobytes() for t in names)], pa.binary()),
                pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array(empty, pa.list_(id_type))]),
                pa.array([lens, *empty], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["range", "term", "offs", "tfs", "docs", "lens"])

        for b in batches:
            id_type, kept = b.schema.field(0).type, []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                at, counts = len(lens), Counter(words)
                for t in counts if wanted is None else wanted.intersection(counts):
                    if t not in offs:
                        offs[t], tfs[t] = array("H"), array("I")
                    offs[t].append(at)
                    tfs[t].append(counts[t])
                lens.append(len(words))
                kept.append(i)
                size += len(text)
            ids.append(b.column(0).take(pa.array(kept, pa.int64())))
            if len(lens) > RANGE_ROWS - BATCH_ROWS or size >= RANGE_BYTES:
                if lens:
                    yield lists()
                offs, tfs, ids, lens, size, number = {}, {}, [], [], 0, number + 1
        if lens:
            yield lists()

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"range bigint, term binary, offs binary, tfs binary, docs array<{kind}>, lens array<bigint>")


def stage_of(mass: dict[int, int], stages: int) -> dict[int, int]:
    """The owner stage of each class of document frequency, from the classes' postings: rare classes first,
    each stage ending once it has its share."""
    total, out, seen = sum(mass.values()), {}, 0
    for c in sorted(mass):
        out[c] = min(seen * stages // max(total, 1), stages - 1)
        seen += mass[c]
    used = sorted(set(out.values()))
    return {c: used.index(s) for c, s in out.items()}


def _add(top: int, n_docs: int, n_terms: int, last: bool):
    """One stage of one bundle and range: its scores so far and the stage's lists, to its scores or, at the
    last stage, its best documents."""

    def run(key: tuple, bundle: pa.Table, lists: pa.Table) -> pa.Table:
        item_type = bundle.schema.field("item_id").type
        rows = lists.to_pylist()
        span = next((r for r in rows if r["docs"] is not None), None)
        lens = span["lens"] if span else []
        m = np.array([50 + 50 * n * n_docs // n_terms for n in lens], np.int64)
        slots: dict = {}
        for i in bundle.column("item_id").to_pylist():
            slots.setdefault(i, len(slots))
        lists_ = [r for r in rows if r["docs"] is None]
        for r in lists_:
            for i in r["items"]:
                slots.setdefault(i["item_id"], len(slots))
        scores = np.zeros((len(slots), len(lens)), np.int64)
        for r in bundle.to_pylist():
            scores[slots[r["item_id"]], np.frombuffer(r["offs"], np.uint16)] += np.frombuffer(r["scores"], np.int64)
        for r in lists_:
            offs, tf = np.frombuffer(r["offs"], np.uint16), np.frombuffer(r["tfs"], np.uint32).astype(np.int64)
            scores[np.ix_([slots[i["item_id"]] for i in r["items"]], offs)] += r["w"] * (1_000_000_000 * tf // (1000 * tf + 20 * m[offs]))
        if not last:
            found = [(i, at, scores[s, at]) for i, s in slots.items() if len(at := np.flatnonzero(scores[s]))]
            columns = [pa.array([i for i, _, _ in found], item_type), pa.array([at.astype(np.uint16).tobytes() for _, at, _ in found], pa.binary()), pa.array([v.tobytes() for _, _, v in found], pa.binary())]
            k = len(found)
            return pa.table([pa.array([key[0].as_py()] * k, pa.int64()), pa.array([key[1].as_py()] * k, pa.int64()), *columns], names=["bundle", "range", "item_id", "offs", "scores"])
        names, best = (span["docs"] if span else []), []
        for i, s in slots.items():
            row = scores[s]
            least = max(int(np.partition(row, -top)[-top]), 1) if len(row) > top else 1
            ranked = sorted(((-int(row[d]), names[d] is None, names[d]) for d in np.flatnonzero(row >= least).tolist()), key=lambda x: x[:2] if x[1] else x)
            best += [(i, d, -v) for v, _, d in ranked[:top]]
        doc_type = lists.schema.field("docs").type.value_type
        return pa.table([pa.array([i for i, _, _ in best], item_type), pa.array([d for _, d, _ in best], doc_type), pa.array([v for _, _, v in best], pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, stages: int = STAGES, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Every document is ranked, whole, for every item.  Equal scores go by ascending doc_id, null last; rows that
    repeat a doc_id are documents of their own.  Null texts, and those without terms, hold nothing and count for
    nothing; such items have no rows, nor have any where either table is empty.  Of other columns none is read.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    wanted = materialize(item_terms(items), "item-terms")
    distinct = wanted.select("term").distinct()
    vocabulary = frozenset(bytes(r["term"]) for r in distinct.collect()) if distinct.count() <= max_terms else None
    index = materialize(inverted(docs, vocabulary), "inverted")
    n_docs, n_terms = index.where(F.col("term").isNull()).agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()
    held = index.where(F.col("term").isNotNull()).join(distinct, "term", "left_semi") if vocabulary is None else index.where(F.col("term").isNotNull())
    df = held.groupBy("term").agg(F.sum(F.expr("octet_length(offs) div 2")).alias("df")).withColumn("class", F.floor(F.log2("df")).cast("int"))
    df = materialize(df, "document-frequencies")
    mass = {r["class"]: r["mass"] for r in df.groupBy("class").agg(F.sum("df").alias("mass")).collect()}
    owner = stage_of(mass, stages)
    if not owner:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint")
    owners = F.create_map([F.lit(v) for cs in owner.items() for v in cs])
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("bigint")
    bundles = -(-wanted.select("item_id").distinct().count() // BUNDLE_ITEMS)
    asked = wanted.join(df, "term").withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)))
    asked = materialize(asked.groupBy("bundle", "term").agg(F.collect_list(F.struct("item_id")).alias("items"), F.first(weight).alias("w"), F.first(owners[F.col("class")]).alias("stage")), "asked-terms")
    spans = index.where(F.col("term").isNull()).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bundles - 1).cast("bigint"))).alias("bundle"), "range", "docs", "lens")
    carried = spark.createDataFrame([], f"bundle bigint, range bigint, item_id {item_kind}, offs binary, scores binary")
    final = max(owner.values())
    for k in range(final + 1):
        lists = index.where(F.col("term").isNotNull()).drop("docs", "lens").join(asked.where(F.col("stage") == k), "term").select("bundle", "range", "offs", "tfs", "items", "w")
        here = lists.unionByName(spans, allowMissingColumns=True)
        schema = f"item_id {item_kind}, doc_id {doc_kind}, score bigint" if k == final else f"bundle bigint, range bigint, item_id {item_kind}, offs binary, scores binary"
        carried = carried.groupBy("bundle", "range").cogroup(here.groupBy("bundle", "range")).applyInArrow(_add(top, n_docs, n_terms, k == final), schema)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return carried.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
