"""Column functions over cycles (arrays of edges) and their text form.

A cycle's text lists its edges, joined by commas: a segment as ``chrom:start-end`` and an
adjacency as ``chrom:pos(strand)-chrom2:pos2(strand2)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One edge as a column: is_adj, chrom, start, strand, chrom2, end, strand2, value.
EDGE = "struct<is_adj:boolean,chrom:string,start:bigint,strand:string,chrom2:string,end:bigint,strand2:string,value:double>"
#: States of the type fold.
NONE, GAIN, LOSS, ADJACENCY_ONLY, MIXED = 0, 1, 2, 3, 4


def edge_text(e: Column) -> Column:
    adjacency = F.concat(e.chrom, F.lit(":"), e.start.cast("string"), F.lit("("), e.strand, F.lit(")-"), e.chrom2, F.lit(":"), e.end.cast("string"), F.lit("("), e.strand2, F.lit(")"))
    return F.when(e.is_adj, adjacency).otherwise(F.concat(e.chrom, F.lit(":"), e.start.cast("string"), F.lit("-"), e.end.cast("string")))


def cycle_text(edges: Column) -> Column:
    return F.array_join(F.transform(edges, edge_text), ",")


def parse_cycle(text: Column, value: Column) -> Column:
    """The edges of a cycle's text; values alternate in sign, starting with ``value``."""
    adjacency, segment = r"^[+-]?([^:]+):(-?[0-9]+)\(([+-])\)-([^:]+):(-?[0-9]+)\(([+-])\)$", r"^[+-]?([^:]+):(-?[0-9]+)-(-?[0-9]+)$"

    def one(part: Column, i: Column) -> Column:
        adj = part.rlike(adjacency)
        pick = lambda a, b: F.when(adj, F.regexp_extract(part, adjacency, a)).otherwise(F.regexp_extract(part, segment, b))
        strand = lambda k: F.when(adj, F.regexp_extract(part, adjacency, k))
        return F.struct(
            adj.alias("is_adj"), pick(1, 1).alias("chrom"), pick(2, 2).try_cast("bigint").alias("start"), strand(3).alias("strand"), pick(4, 1).alias("chrom2"),
            pick(5, 3).try_cast("bigint").alias("end"), strand(6).alias("strand2"), F.when(i % 2 == 0, value).otherwise(-value).alias("value"),
        )

    return F.transform(F.split(text, ","), one)


def strip_signs(text: Column) -> Column:
    """A cycle's text without the signs that may stand before its edges."""
    return F.regexp_replace(text, r"(^|,)[+-]", "$1")


def reverse_cycle(edges: Column) -> Column:
    return F.reverse(edges)


def start_at(edges: Column, index: Column) -> Column:
    """The cycle rotated so that edge ``index`` (from 0) comes first."""
    return F.concat(F.slice(edges, index + 1, F.size(edges) - index), F.slice(edges, F.lit(1), index))


def alternate(values: Column, ratio: Column) -> Column:
    """Values of alternating sign and size ``ratio``."""
    return F.transform(values, lambda _, i: F.when(i % 2 == 0, ratio).otherwise(-ratio))


def event_ratio(value: Column) -> Column:
    """|v| over |v| rounded up (null for 0)."""
    return F.try_divide(F.abs(value), F.ceil(F.abs(value)))


def event_type(values: Column) -> Column:
    """Type of a cycle from its segments' file values in order: a fold whose state moves with
    each segment.  A negative file value is a gain.  Mixed is left again by the next segment."""

    def step(state: Column, v: Column) -> Column:
        return F.when((v < 0) & (state != LOSS), GAIN).when((v > 0) & (state != GAIN), LOSS).otherwise(MIXED)

    return F.aggregate(values, F.lit(NONE), step, lambda s: F.when(s == NONE, ADJACENCY_ONLY).otherwise(s))


def ordered_ends(chrom: Column, start: Column, chrom2: Column, end: Column) -> Column:
    """An adjacency's ends with the lesser (chrom, position) first, and whether they were swapped."""
    swap = (chrom > chrom2) | ((chrom == chrom2) & (start > end))
    return F.struct(F.when(swap, chrom2).otherwise(chrom).alias("chrom"), F.when(swap, end).otherwise(start).alias("start"), F.when(swap, chrom).otherwise(chrom2).alias("chrom2"), F.when(swap, start).otherwise(end).alias("end"), swap.alias("swapped"))


def touches(edges: Column, chrom: str, start: int, finish: int) -> Column:
    """Whether an event overlaps a region: segments strictly, ends of adjacencies inclusively."""

    def hit(e: Column) -> Column:
        end_in = lambda c, p: (c == chrom) & (p >= start) & (p <= finish)
        return F.when(e.is_adj, end_in(e.chrom, e.start) | end_in(e.chrom2, e.end)).otherwise((e.chrom == chrom) & (e.start < finish) & (e.end > start))

    return F.exists(edges, hit)


def segment_length(edges: Column) -> Column:
    """Total inclusive length of a cycle's segments."""
    return F.aggregate(F.filter(edges, lambda e: ~e.is_adj), F.lit(0).cast("bigint"), lambda s, e: s + F.abs(e.end - e.start) + 1)


def ancestral_offset(value: Column, mean: Column, ploidy: Column) -> Column:
    """Flow of an ancestral edge as an offset from its ploidy, in units of 2/ploidy."""
    return (F.try_divide(value, mean) * ploidy - 1) * 2 / ploidy


def novel_offset(value: Column, mean: Column) -> Column:
    return F.greatest(F.lit(0.0), F.try_divide(value, mean) * 2)


def half_away_from_zero(x: Column) -> Column:
    return F.round(x)


def floor_half(x: Column) -> Column:
    """Midpoint division that rounds down for negative numbers, too."""
    return F.floor(x / 2)


# Cycles are short arrays; an edge read the other way is the same edge.


def flipped(e: Column) -> Column:
    """The edge with its ends (and strands) exchanged."""
    return F.struct(e.is_adj.alias("is_adj"), e.chrom2.alias("chrom"), e.end.alias("start"), e.strand2.alias("strand"), e.chrom.alias("chrom2"), e.start.alias("end"), e.strand.alias("strand2"), e.value.alias("value"))


def lower_end_first(e: Column) -> Column:
    return F.when((e.chrom > e.chrom2) | ((e.chrom == e.chrom2) & (e.start > e.end)), flipped(e)).otherwise(e)


def _ends(e: Column) -> tuple[Column, Column]:
    return F.struct(e.chrom, e.start), F.struct(e.chrom2, e.end)


def _touches(point: Column, e: Column) -> Column:
    """Whether ``point``, an end of another edge, is the same kind of end of ``e``, or its other one."""
    low, high = _ends(e)
    return (point == low) | (point == high)


def canonical(edges: Column) -> Column:
    """The cycle in the one order that equal cycles share: from its lowest edge (by ends, then strands), which is
    read from its lower end, on in the direction in which the next edge takes up its higher end, each
    edge flipped to read on from the one before.  A cycle whose neighbours meet at neither end keeps its direction."""
    ordered = F.transform(edges, lower_end_first)
    key = lambda e: F.struct(e.chrom, e.start, e.chrom2, e.end, e.strand, e.strand2)
    keys = F.transform(ordered, key)
    first = (F.array_position(keys, F.array_min(keys)) - 1).cast("int")

    def from_first(c: Column) -> Column:
        """c: the ordered edges and the place of the first."""
        e, i, n = c.e, c.i, F.size(c.e)
        at = lambda k: F.get(e, F.pmod(k, n))
        low, high = _ends(at(i))
        second, last = at(i + 1), at(i - 1)
        on = _touches(high, second) & _touches(low, last)
        back = ~on & _touches(high, last) & _touches(low, second)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(F.when(back, i - k).otherwise(i + k)))

    def read_on(done: Column, e: Column) -> Column:
        before = F.element_at(done, -1)
        turned = (F.size(done) > 0) & (before.chrom2 == e.chrom2) & (before.end == e.end)
        return F.concat(done, F.array(F.when(turned, flipped(e)).otherwise(e)))

    turned = F.transform(F.array(F.struct(ordered.alias("e"), first.alias("i"))), from_first)[0]
    none = F.slice(ordered, 1, 0)
    return F.when(F.size(edges) > 1, F.aggregate(turned, none, read_on)).otherwise(ordered)


def split_figure_eights(edges: Column) -> Column:
    """The simple cycles of a cycle that comes back to a point: array of cycles.

    Going along the edges, one that starts where an earlier one did, an even number of edges before, closes
    what lies between as a cycle of its own.
    """
    start = lambda s: s.open

    def step(s: Column, e: Column) -> Column:
        n = F.size(start(s))
        same = F.filter(F.sequence(F.lit(0), n), lambda k: (k < n) & ((n - k) % 2 == 0) & (F.get(start(s), k).start == e.start) & (F.get(start(s), k).chrom == e.chrom))
        at = F.array_min(same)
        closes = at.isNotNull()
        kept = F.when(closes, F.slice(start(s), F.lit(1), F.coalesce(at, F.lit(0)))).otherwise(start(s))
        cut = F.slice(start(s), F.coalesce(at, F.lit(0)) + 1, n - F.coalesce(at, F.lit(0)))
        return F.struct(F.concat(kept, F.array(e)).alias("open"), F.when(closes, F.concat(s.done, F.array(cut))).otherwise(s.done).alias("done"))

    none = F.slice(edges, 1, 0)
    return F.aggregate(edges, F.struct(none.alias("open"), F.slice(F.array(none), 1, 0).alias("done")), step, lambda s: F.filter(F.concat(s.done, F.array(s.open)), lambda c: F.size(c) > 0))


def merge_adjacent(edges: Column) -> Column:
    """The cycle without adjacencies that join neighbouring positions of a chromosome between two segments: the
    segments become one from the least to the greatest of their ends.  The cycle closes: the last edge's
    neighbour is the first.  Cycles of fewer than three edges stay as they are."""

    def step(s: Column, _: Column) -> Column:
        e, i, n = s.e, s.i, F.size(s.e)
        at = lambda k: F.get(e, F.pmod(k, n))
        here, before, after = at(i), at(i - 1), at(i + 1)
        trivial = (i < n) & (n > 2) & here.is_adj & (here.chrom == here.chrom2) & (F.abs(here.start - here.end) == 1) & ~before.is_adj & ~after.is_adj
        low, high = F.least(before.start, before.end, after.start, after.end), F.greatest(before.start, before.end, after.start, after.end)
        wider = F.struct(before.is_adj.alias("is_adj"), before.chrom.alias("chrom"), low.alias("start"), before.strand.alias("strand"), before.chrom2.alias("chrom2"), high.alias("end"), before.strand2.alias("strand2"), before.value.alias("value"))
        kept = F.filter(F.transform(e, lambda x, k: F.struct(F.when(k == F.pmod(i - 1, n), wider).otherwise(x).alias("x"), ((k != i) & (k != F.pmod(i + 1, n))).alias("stays"))), lambda x: x.stays)
        return F.struct(F.when(trivial, F.transform(kept, lambda x: x.x)).otherwise(e).alias("e"), F.when(trivial, i).otherwise(i + 1).alias("i"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(edges), F.lit(1))), F.struct(edges.alias("e"), F.lit(0).alias("i")), step, lambda s: s.e)


def edge_counts(edges: Column) -> Column:
    """Segments and adjacencies of a cycle."""
    return F.struct(F.size(F.filter(edges, lambda e: ~e.is_adj)).alias("numsegs"), F.size(F.filter(edges, lambda e: e.is_adj)).alias("numadjs"))


def is_breakpoint(e: Column) -> Column:
    """An adjacency of two neighbouring positions of one chromosome."""
    return e.is_adj & (e.chrom == e.chrom2) & (F.abs(e.start - e.end) == 1)


def crosses(a: Column, b: Column) -> Column:
    """Whether two edges of one chromosome overlap without one holding the other (or sharing an end)."""
    (al, ah), (bl, bh) = ((F.least(x.start, x.end), F.greatest(x.start, x.end)) for x in (a, b))
    one = (a.chrom == a.chrom2) & (b.chrom == b.chrom2) & (a.chrom == b.chrom)
    return one & (((al > bl) & (al < bh) & (ah > bh)) | ((al < bl) & (ah < bh) & (ah > bl)))


def connected(a: Column, b: Column) -> Column:
    """Whether two edges share an end."""
    return _touches(_ends(a)[0], b) | _touches(_ends(a)[1], b)


def same_ends(a: Column, b: Column) -> Column:
    """Whether two edges have the same two ends, in either order."""
    (al, ah), (bl, bh) = _ends(a), _ends(b)
    return ((al == bl) & (ah == bh)) | ((al == bh) & (ah == bl))


def same_place(a: Column, b: Column) -> Column:
    """Whether two edges are equal but for their values; nulls equal nulls."""
    kept = ("is_adj", "chrom", "start", "strand", "chrom2", "end", "strand2")
    return F.struct(*(a[k] for k in kept)).eqNullSafe(F.struct(*(b[k] for k in kept)))


def significant(ratio: Column, cutoff: float = 0.1) -> Column:
    """Whether an event's flow ratio is large enough to keep."""
    return F.abs(ratio) > cutoff
