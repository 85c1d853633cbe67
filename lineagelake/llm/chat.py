"""Chat formatting over a prefix tree.

Conversations that share their first turns share those turns' nodes.  A node is named by a 128-bit
hash of its whole prefix: running exclusive-ors, along each conversation, of a hash of every turn and its
place.  So the tree is one aggregation, and no task ever holds a tree, or a long conversation: rows
are range-partitioned by conversation and turn, and what a conversation has gathered is carried from part
to part.

The layout puts each node's text, or its tokens, once, depth first.  Conversations are ranked by the
children they take where the tree branches, so those that share a node are neighbours; a node comes at
the rank of the first that holds it.  Each node has the position of its first unit on its path (the position
ids of its units count on from there), its place [offset, offset + length) in the layout, and the place
where its subtree ends.  A unit attends to an earlier one if and only if it lies within [offset, until) of
the earlier one's node, so a node's ancestors are those whose interval holds its offset: one
interval a node says it, whatever the depth.

Texts stay out of all this: they are read for their hashes and lengths, and once more to be put into the nodes.

The template puts ``ROLE_OPEN`` role ``ROLE_CLOSE`` text ``TURN_END`` for each turn.  The escape
character ``\\`` is put behind every mark's first character inside texts and roles, and
behind itself, so the marks never occur inside a turn and texts come back unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Fold, in_parts, running
from . import bpe
from .common import map_batches, materialize, shuffle_partitions, with_row_ids

ROLE_OPEN, ROLE_CLOSE, TURN_END = "[INST:", "]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<])\\", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE))


def _body(text: Column) -> Column:
    return F.concat(escape(text), F.lit(TURN_END))


def steps_of(rows: DataFrame) -> DataFrame:
    """(row, conv_id, level, node, parent, role, length, start): each conversation's turns in order.

    ``rows``: row, conv_id, turn, role, text.  Rows of one turn number follow by role, then by the text's
    SHA-256, then by row; a null turn number comes first; null conv_ids form one conversation.  ``length``
    counts the formatted characters, ``start`` those before the turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = rows.select("row", "conv_id", "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), (F.char_length(_head(role)) + F.char_length(_body(text))).cast("long").alias("length"))
    by, order = ["conv_id"], ["turn", "role", "digest", "row"]
    placed = running(in_parts(light, by, order), by, order, {"level": Fold("count", F.lit(1), own=False), "start": Fold("sum", F.col("length"), own=False)})
    turn = lambda seed: Fold("xor", F.xxhash64("digest", "role", "level", F.lit(seed)))
    folds = {f"{name}{k}": Fold("xor", turn(k).value, own=own) for k in (1, 2) for name, own in (("node", True), ("parent", False))}
    name = lambda n: F.concat(*(F.lpad(F.hex(f"{n}{k}"), 16, "0") for k in (1, 2)))
    return running(placed, by, order, folds).select("row", "conv_id", "level", name("node").alias("node"), name("parent").alias("parent"), "role", "length", F.coalesce("start", F.lit(0).cast("long")).alias("start"))


def tree(steps: DataFrame) -> DataFrame:
    """The prefix tree's nodes: node, parent, depth, role, length, start, row (one that holds its text)."""
    return steps.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "role", "length", "start")), F.first("level").alias("depth"), F.min("row").alias("row")).withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))


def lay_out(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Add ``offset`` and ``until`` to the nodes (node, parent, depth, length, ...) of the conversations ``steps``.

    A conversation has a key of the children it takes at branches.  Its branching ancestors number at
    most the square root of twice all turns, as each needs another conversation that long.
    """
    branches = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent")
    taken = nodes.where("parent IS NULL").select("node").unionByName(nodes.join(branches, "parent", "left_semi").select("node"))
    keys = steps.select("conv_id", "level", "node").join(taken, "node").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("key"))
    order = ["key", "conv_id"]
    ranked = running(in_parts(keys, [], order), [], order, {"rank": Fold("count", F.lit(1), own=False)}).select("conv_id", "rank")
    held = steps.select(F.col("conv_id").alias("c"), "node").join(ranked, F.col("c").eqNullSafe(F.col("conv_id"))).select("rank", "node")
    held = materialize(held, "chat-held")
    first = materialize(nodes.select("node", "depth", "length").join(held.groupBy("node").agg(F.min("rank").alias("first")), "node"), "chat-first")
    laid = running(in_parts(first, [], ["first", "depth"]), [], ["first", "depth"], {"offset": Fold("sum", F.col("length"), own=False)})
    laid = laid.withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
    # the last rank at which a conversation that holds the node adds to the layout; its subtree ends there
    adds = held.join(first.select("node", "first"), "node").groupBy("rank").agg(F.max("first").alias("last"))
    last = held.join(adds, "rank").groupBy("node").agg(F.max("last").alias("last"))
    ends = laid.groupBy(F.col("first").alias("last")).agg(F.max(F.col("offset") + F.col("length")).alias("until"))
    places = laid.select("node", "offset").join(last, "node").join(ends, "last").select("node", "offset", "until")
    return nodes.join(places, "node")


def format_chats(conversations: DataFrame, tokenizer: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed output: (nodes, chains).

    nodes: node, parent, depth, role, head, body, start, length, offset, until; a node's text is
    ``head || body``, its loss mask covers ``body`` without the end mark where the role is
    assistant.  chains: conv_id, at: the offset of each conversation's last node, from which the layout
    gives all its turns.

    Units are characters; with ``tokenizer`` (path of a rank file, pattern) they are the tokens of each
    node's text, which nodes then hold in ``ids`` (little-endian unsigned 32-bit).  A null role or text is
    empty; repeated rows are repeated turns; an empty table gives no nodes.
    """
    rows = with_row_ids(conversations.select("conv_id", "turn", "role", "text"), "row")
    steps = materialize(steps_of(rows), "chat-steps")
    nodes = materialize(tree(steps), "chat-tree")
    text = rows.select("row", _head(F.coalesce("role", F.lit(""))).alias("head"), _body(F.coalesce("text", F.lit(""))).alias("body"))
    worded = nodes.join(text, "row").drop("row")
    if tokenizer:
        worded = materialize(worded, "chat-worded")
        coded = materialize(bpe.encode(worded.select("node", F.concat("head", "body").alias("text")), *tokenizer, id_col="node").withColumnRenamed("doc_id", "node"), "chat-coded")
        sizes = coded.select("node", (F.octet_length("ids") / 4).cast("long").alias("length"))
        by, order = ["conv_id"], ["level"]
        starts = running(in_parts(steps.select("conv_id", "level", "node").join(sizes, "node"), by, order), by, order, {"start": Fold("sum", F.col("length"), own=False)})
        starts = starts.groupBy("node", "length").agg(F.coalesce(F.first("start"), F.lit(0).cast("long")).alias("start"))
        nodes = materialize(nodes.drop("length", "start").join(starts, "node"), "chat-tree")
        worded = nodes.drop("row").join(worded.select("node", "head", "body"), "node").join(coded, "node")
    places = materialize(lay_out(nodes.select("node", "parent", "depth", "length"), steps), "chat-places").select("node", "offset", "until")
    last = steps.groupBy("conv_id").agg(F.max_by("node", "level").alias("node"))
    chains = last.join(places.select("node", F.col("offset").alias("at")), "node").select("conv_id", "at")
    return materialize(worded.join(places, "node"), "chat-nodes"), materialize(chains, "chat-chains")


def ancestors(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(at, node): for each place ``at`` of ``places`` at which a node begins, that node and those whose attention interval
    holds the place.

    nodes: node, depth, offset, until.  Depth first, the ancestor at a depth is the last node of that depth up to
    the place, if its interval reaches beyond it: a running value along each depth, whatever the length of a chain.
    """
    none = lambda kind: F.lit(None).cast(kind)
    given = nodes.select("depth", F.col("offset").alias("place"), F.lit(0).alias("asked"), "node", "until")
    asked = places.select("at").distinct().join(nodes.select(F.col("offset").alias("at"), F.col("depth").alias("deepest")), "at")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deepest").cast("bigint"))).alias("depth"), F.col("at").alias("place"), F.lit(1).alias("asked"), none("string").alias("node"), none("bigint").alias("until"))
    by, order = ["depth"], ["place", "asked"]
    rows = in_parts(given.withColumn("depth", F.col("depth").cast("bigint")).unionByName(asked), by, order)
    seen = running(rows, by, order, {"above": Fold("last", F.when(F.col("asked") == 0, F.struct("node", "until")))})
    return seen.where("asked = 1 AND above.until > place").select(F.col("place").alias("at"), F.col("above.node").alias("node"))


def read_back(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, level, role, text, loss, length): each turn as the packed output gives it; ``loss`` is the text
    under the loss mask.

    A conversation's turns are the ancestors of its last node by the layout's intervals, in the order of their
    first positions, which ``level`` is.
    """
    held = materialize(ancestors(nodes, chains), "chat-ancestors")
    text = F.expr(f"substring(body, 1, char_length(body) - {len(TURN_END)})")
    role = F.expr(f"substring(head, {len(ROLE_OPEN) + 1}, char_length(head) - {len(ROLE_OPEN) + len(ROLE_CLOSE)})")
    plain = nodes.select("node", F.col("start").alias("level"), unescape(role).alias("role"), unescape(text).alias("text"), (F.char_length("head") + F.char_length("body")).cast("long").alias("length"))
    return chains.join(held, "at").join(plain, "node").select("conv_id", "level", "role", "text", F.when(F.col("role") == ASSISTANT, F.col("text")).otherwise("").alias("loss"), "length")


def with_digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what ``read_back`` returns.

    A conversation's digest is one chain of its turns: they stream through a task in order, one batch at a time.
    """
    kind = back.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (back.select("conv_id").limit(0).toArrow().schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        close = lambda: (at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for b in batches:
            done = []
            for conv, role, text, loss, length in zip(*(c.to_pylist() for c in b.columns)):
                if at != (conv,):
                    if at:
                        done.append(close())
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += length
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=names)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), types)], names=names)

    ordered = back.repartition(shuffle_partitions(back.sparkSession), "conv_id").sortWithinPartitions("conv_id", "level").select("conv_id", "role", "text", "loss", "length")
    return map_batches(ordered, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
