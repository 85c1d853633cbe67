"""MinHash near-duplicate groups by tensored banding.

Two collections of ``SIDE`` groups of ``GROUP`` minhashes each are computed.  A table key combines a group of
the first with a group of the second, so ``SIDE`` ** 2 tables of 2 * ``GROUP`` minhashes cost
2 * ``SIDE`` * ``GROUP`` of them (96) instead of 2 * ``GROUP`` * ``SIDE`` ** 2 (1536).  Two sets at the threshold
of 0.8 share no table with chance 2 * (1 - 0.8 ** 3) ** 16, about 2 in 100,000; at 0.9, 4 in 10 ** 10.

Equal sets are one class from the start.  A table key can only be shared where its first half is, so keys are
formed for shared halves alone: a document that resembles none forms none.

Links are found without forming the pairs of a crowded key, and without repeating them for every key that two
documents share.  A key's pivot is its least class; a class is at home with the least pivot of its keys, and small
homes whose pivots' pivots lead to one class are put together.  Homes are cut into blocks of ``BLOCK`` classes.  First each
block is compared within itself; then one comparison is tried for every two groups so found that meet under a key.
A key whose classes are one group by then is settled.  Only classes that hold another key are dealt out again: blocks
of one home, and of homes that meet under such a key, are compared with each other.  A task compares the likeliest pairs first
and skips those that links already join, so a large group of near copies costs little more than a comparison a member.

A comparison looks at set sizes and two bits of each of the 96 minhashes first and then intersects the full
sets of shingle hashes (64 bits), made from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import fresh_name, map_batches, materialize, with_row_ids
from .decontam import Shingler

SHINGLE_WORDS, PERCENT = 4, 80
SIDE, GROUP = 16, 3
LANES = 2 * SIDE * GROUP
#: Lanes whose two low bits must agree: sets at the threshold agree in 0.85 of 96, so that fewer than 60 has chance below 10 ** -7.
AGREE = 60
#: Classes of one block, about.
BLOCK = 256
#: Most classes whose places are broadcast to fetch their texts; beyond, places and texts are joined by a shuffle.
MAX_PLACES = 400_000
_RNG = np.random.default_rng(20)
_XOR, _ODD = _RNG.integers(0, 1 << 64, LANES, np.uint64)[:, None], _RNG.integers(0, 1 << 64, LANES, np.uint64)[:, None] | np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 64, 3, np.uint64) | np.uint64(1)


def shingle_set(shingler: Shingler, text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingler.hashes(text))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of each lane's least permuted hash."""
    low = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[None, at : at + 512] ^ _XOR) * _ODD).min(axis=1), out=low)
    return ((low ^ (low >> np.uint64(29))) * _FOLD[0] >> np.uint64(48)).astype(np.uint16)


def _named(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = hashes * _FOLD[1]
    b = (hashes ^ (hashes >> np.uint64(31))) * _FOLD[2]
    return tuple(int((x ^ (x >> np.uint64(32))).sum(dtype=np.uint64).astype(np.int64)) for x in (a, b))


def signed(docs: DataFrame, row: str, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, s1, s2, u, v, bits): set size and name, the two collections' groups (48 bits each) and two bits a lane."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(SHINGLE_WORDS)
        for b in batches:
            size, names, lanes = [], [], np.zeros((len(b), LANES), np.uint16)
            for i, text in enumerate(b.column(2).to_pylist()):
                hashes = shingle_set(shingler, text)
                size.append(len(hashes))
                names.append(_named(hashes))
                if len(hashes):
                    lanes[i] = minhashes(hashes)
            wide = lanes.astype(np.int64).reshape(len(b), 2, SIDE, GROUP)
            keys = wide[..., 0] << 32 | wide[..., 1] << 16 | wide[..., 2]
            two = np.packbits(np.stack((lanes & 1, lanes >> 1 & 1), axis=2).reshape(len(b), -1).astype(np.uint8), axis=1).view(np.int64)
            as_list = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), pa.int64()), m.shape[1]).cast(pa.list_(pa.int64()))
            columns = [b.column(0), b.column(1), pa.array(size, pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), as_list(keys[:, 0]), as_list(keys[:, 1]), as_list(two)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "s1", "s2", "u", "v", "bits"])

    return map_batches(docs.select(F.col(row), F.col(id_col), F.col(text_col)), run, f"row string, doc_id {kind}, n bigint, s1 bigint, s2 bigint, u array<bigint>, v array<bigint>, bits array<bigint>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): the table keys whose first half another class has, too."""
    halves = classes.select("cls", F.posexplode("u").alias("i", "part")).select("cls", "i", F.xxhash64("i", "part").alias("half"))
    crowded = materialize(halves.groupBy("half").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("half"), "shared-halves")
    alive = halves.join(crowded, "half").groupBy("cls").agg(F.collect_list("i").alias("at"))
    both = classes.select("cls", "u", "v").join(alive, "cls").select("cls", "u", "v", F.explode("at").alias("i"))
    return both.select("cls", "i", F.col("u")[F.col("i")].alias("part"), F.posexplode("v").alias("j", "other")).select(F.xxhash64("i", "part", "j", "other").alias("key"), "cls")


def _texts(rows: DataFrame, row: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(cls, packed): the compressed texts of the classes' first rows; wanted: cls, row."""
    places = wanted.select(F.col("row").alias(row), "cls")
    if places.count() <= MAX_PLACES:
        places = F.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())], names=["cls", "packed"])

    found = rows.select(F.col(row), F.col(text_col).alias("text")).join(places, row).select("cls", "text")
    return map_batches(found, run, "cls bigint, packed binary")


def agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Lanes whose two bits agree, of every row of ``one`` with every row of ``two``."""
    differ = one[:, None, :] ^ two[None, :, :]
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return LANES - np.bitwise_count(differ).sum(axis=2, dtype=np.int64)


def linked_pairs(labels: list[int], sizes: list[int], bits: np.ndarray, packed: list[bytes], across: np.ndarray | None) -> tuple[list[tuple[int, int]], list[int]]:
    """Verified links (i, j) that join rows of different labels, no more than it takes, and each row's group after them.

    The likeliest pairs come first; pairs that are one group by then need no comparison.  ``across``: of which
    side each row is, if only pairs of both sides are asked for.
    """
    shingler, unpack = Shingler(SHINGLE_WORDS), zstandard.ZstdDecompressor()
    n, names = np.array(sizes), np.unique(labels, return_inverse=True)[1]
    left, right = (np.arange(len(n)),) * 2 if across is None else (np.flatnonzero(across == 0), np.flatnonzero(across == 1))
    agree = agreement(bits[left], bits[right])
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    likely = (agree >= AGREE) & (100 * small >= PERCENT * large) & (names[left][:, None] != names[right])
    if across is None:
        likely &= np.tri(len(n), k=-1, dtype=bool).T
    at = np.flatnonzero(likely)
    at = at[np.argsort(-agree.ravel()[at], kind="stable")]
    parent = list(range(int(names.max(initial=0)) + 1))
    sets: dict[int, np.ndarray] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(shingler, unpack.decompress(packed[i]).decode("utf-8", "surrogatepass"))
        return sets[i]

    found = []
    for i, j in zip(left[at // max(len(right), 1)].tolist(), right[at % max(len(right), 1)].tolist()):
        a, b = root(names[i]), root(names[j])
        if a == b:
            continue
        one, two = full(i), full(j)
        short, long = (one, two) if len(one) < len(two) else (two, one)
        place = np.minimum(np.searchsorted(long, short), len(long) - 1)
        shared = int((long[place] == short).sum())
        if 100 * shared >= PERCENT * (len(one) + len(two) - shared):
            parent[b] = a
            found.append((i, j))
    return found, [root(x) for x in names]


def _compare(dealt: DataFrame, within: bool) -> DataFrame:
    """(a, b), written: links within each task's rows, or across its two sides.

    dealt: p, block, q, other (they name a task), side, cls, label, n, bits, packed.  Within a task, b is every member
    of a group and a its least; across, links as they were found.
    """
    task = ["p", "block", "q", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple[int, int]] = []
        for _, group in groupby(rows, key=lambda r: r[:4]):
            side, cls, labels, sizes, bits, packed = map(list, zip(*(r[4:] for r in group)))
            if len(cls) > 1:
                across = None if within else np.array(side)
                found, groups = linked_pairs(labels, sizes, np.array(bits, np.int64).view(np.uint64), packed, across)
                if within:
                    least: dict[int, int] = {}
                    for c, g in zip(cls, groups):
                        least[g] = min(least.get(g, c), c)
                    out += [(least[g], c) for c, g in zip(cls, groups) if c != least[g]]
                else:
                    out += [(cls[i], cls[j]) for i, j in found]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    together = dealt.repartition(*task).sortWithinPartitions(*task)
    return materialize(map_batches(together.select(*task, "side", "cls", "label", "n", "bits", "packed"), run, "a bigint, b bigint"), "links")


def _homes(buckets: DataFrame) -> DataFrame:
    """(cls, p): each class's home.  A class is at home with the least pivot of its keys; homes of fewer than ``BLOCK``
    classes whose pivots' pivots lead to one class share rooms of about ``BLOCK``, each home in one of them."""
    least = materialize(buckets.groupBy("cls").agg(F.min("pivot").alias("p")), "least-pivots")
    sized = least.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    up, step = sized.select("p", "size", F.col("p").alias("top")), least.select(F.col("cls").alias("top"), F.col("p").alias("next"))
    for _ in range(3):
        up = up.join(step, "top").select("p", "size", F.col("next").alias("top"))
    up = materialize(up, "pivots-of-pivots")
    small = up.where(F.col("size") < BLOCK)
    rooms = small.groupBy("top").agg(F.ceil(F.sum("size") / BLOCK).alias("rooms"))
    shared = small.join(rooms, "top").select("p", F.xxhash64("top", F.pmod(F.xxhash64("p"), F.col("rooms"))).alias("home"))
    return least.join(shared, "p", "left").select("cls", F.coalesce("home", F.xxhash64("p", F.lit(-1))).alias("p"))


def _open(held: DataFrame) -> DataFrame:
    """(key): keys under which classes of different labels and blocks meet, which no comparison has had before it."""
    unit = F.struct("p", "block")
    both = held.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min(unit).alias("c"), F.max(unit).alias("d"))
    return both.where("a < b AND c <> d").select("key")


def _bridges(held: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links found by one comparison for every two labels that meet under a key, the least label of a key with each other."""
    ends = materialize(held.groupBy("key", "label").agg(F.min("cls").alias("cls")), "labels-of-keys")
    star = ends.join(ends.groupBy("key").agg(F.min(F.struct("label", "cls")).alias("low")), "key").where(F.col("label") > F.col("low.label"))
    pairs = star.groupBy(F.col("low.label").alias("p"), F.col("label").alias("q")).agg(F.min(F.struct(F.col("low.cls").alias("one"), F.col("cls").alias("two"))).alias("e"))
    none = F.lit(0).alias("block"), F.lit(0).alias("other")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("e.one").alias("cls"), F.col("p").alias("label")), F.struct(F.lit(1).alias("side"), F.col("e.two").alias("cls"), F.col("q").alias("label")))
    sides = materialize(pairs.select("p", *none, "q", F.explode(sides).alias("s")).select("p", "block", "q", "other", "s.*"), "bridges-to-try")
    return _compare(sides.join(members.select("cls", "n", "bits", "packed"), "cls"), within=False)


def links(rows: DataFrame, row: str, text_col: str, classes: DataFrame) -> DataFrame:
    """(a, b): links between classes, enough of them to connect every two that links connect."""
    keys = table_keys(classes)
    shared = materialize(keys.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("top")).where("pivot < top").select("key", "pivot"), "shared-keys")
    buckets = materialize(keys.join(shared, "key"), "buckets")
    home = materialize(_homes(buckets), "homes")
    blocks = materialize(home.groupBy("p").agg(F.greatest(F.round(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias("m")), "home-blocks")
    places = home.join(classes.select("cls", "row", "n", "bits"), "cls").join(blocks, "p")
    places = materialize(places.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int")), "places")
    members = materialize(_texts(rows, row, text_col, places.select("cls", "row")).join(places.drop("row"), "cls"), "members")
    own = members.select("p", "block", F.col("p").alias("q"), F.col("block").alias("other"), F.lit(0).alias("side"), "cls", F.col("cls").alias("label"), "n", "bits", "packed")
    first = _compare(own, within=True)
    label = F.coalesce("label", "cls").alias("label")
    held = buckets.select("key", "cls").join(places.select("cls", "p", "block"), "cls").join(first.select(F.col("b").alias("cls"), F.col("a").alias("label")), "cls", "left").select("key", "cls", "p", "block", label)
    held = materialize(held.join(_open(held), "key"), "open-keys")
    bridges = _bridges(held, members)
    found = first.unionByName(bridges)
    group = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("cls"), F.col("component").alias("label"))
    held = held.drop("label").join(group, "cls", "left").select("key", "cls", "p", "block", label)
    held = materialize(held.join(_open(held), "key"), "keys-still-open")
    asked = materialize(held.select("cls", "label").distinct(), "classes-still-open")
    labelled = members.join(asked, "cls")
    # homes that an open key has in common, and the blocks of one home
    met = held.select("key", "p").distinct()
    several = materialize(met.groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low < high").select("key"), "keys-of-homes")
    met = materialize(met.join(several, "key"), "homes-that-meet")
    pairs = met.join(met.withColumnRenamed("p", "q"), "key").where("p < q").select("p", "q").distinct()
    cut = held.groupBy("key", "p").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("p").distinct()
    pairs = materialize(pairs.unionByName(cut.select("p", F.col("p").alias("q"))), "home-pairs")
    sized = pairs.join(blocks, "p").join(blocks.select(F.col("p").alias("q"), F.col("m").alias("k")), "q")
    ends = materialize(sized.select(F.explode(F.array(F.struct(F.col("p").alias("home"), F.lit(0).alias("side"), "p", "q", F.col("k").alias("there")), F.struct(F.col("q").alias("home"), F.lit(1).alias("side"), "p", "q", F.col("m").alias("there")))).alias("e")).select("e.*"), "home-ends")
    dealt = labelled.withColumnRenamed("p", "home").join(ends, "home").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
    # one home's blocks meet once, the lower one on the left
    kept = (F.col("p") != F.col("q")) | F.when(F.col("side") == 0, F.col("block") < F.col("x")).otherwise(F.col("block") > F.col("x"))
    mine, theirs = F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("x")), F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("block"))
    dealt = dealt.where(kept).select("p", mine.alias("block"), "q", theirs.alias("other"), "side", "cls", "label", "n", "bits", "packed")
    return found.unionByName(_compare(dealt, within=False))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links of at least ``PERCENT`` / 100 similarity, the
    document itself included; null ids name no component unless all its members' are null.  ``kept`` tells whether
    that is the row's own id (rows that repeat an id are kept or dropped together).  A text of fewer than
    ``SHINGLE_WORDS`` words is one shingle and links with equal ones alone; null texts and those without words have
    none and link with nothing.  Texts of any length are hashed whole, a megabyte at a time.  Other columns
    are not read, whatever their names; an empty table gives no rows.
    """
    row = fresh_name(docs, "row")
    rows = with_row_ids(docs, row)
    marked = materialize(signed(rows, row, id_col, text_col).withColumn("number", F.monotonically_increasing_id()), "minhashes")
    name = ["n", "s1", "s2"]
    full = marked.where("n > 0")
    classes = full.groupBy(*name).agg(F.min("number").alias("cls"), F.min_by("row", "number").alias("row"), F.min("doc_id").alias("low"), F.first("u").alias("u"), F.first("v").alias("v"), F.first("bits").alias("bits"))
    classes = materialize(classes, "distinct-sets")
    root = components(links(rows, row, text_col, classes).select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")
    grouped = classes.select(*name, "cls", "low").join(root, "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    lowest = materialize(grouped.groupBy("root").agg(F.min("low").alias("component_id")), "lowest-ids")
    label = materialize(grouped.join(lowest, "root").select(*name, "component_id"), "labels")
    out = full.join(label, name).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
