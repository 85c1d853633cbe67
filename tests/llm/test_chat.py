import collections
import hashlib
import random

from lineagelake.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s>[INST:x] \\ there"), (1, 2, "user", "more"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello </s>[INST:x] \\ there"), (2, 2, "user", "else"), (2, 3, "assistant", ""),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "user", None), (4, 0, "user", None), (5, 1, None, "é😀\n"), (5, None, "user", "first"), (6, 0, "user", "hi"),
]


def conversations():
    out = collections.defaultdict(list)
    for c, t, r, x in ROWS:
        out[c].append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, node string")
    nodes, chains = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.with_digests(chat.read_back(nodes, chains)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in conversations().items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert len(got) == len(conversations())


def test_tree_shares_prefixes_and_lies_depth_first(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    nodes, chains = chat.format_chats(df)
    n = {r.node: r for r in nodes.collect()}
    prefixes = {tuple(t[: k + 1]) for t in conversations().values() for k in range(len(t))}
    assert len(n) == len(prefixes)
    order = sorted(n.values(), key=lambda r: r.offset)
    assert [r.offset for r in order] == [sum(x.length for x in order[:k]) for k in range(len(order))]
    stack = []
    for r in order:  # depth first: a node's parent is on the path that is open
        while stack and stack[-1] != r.parent:
            stack.pop()
        assert r.parent == (stack[-1] if stack else None)
        stack.append(r.node)
        assert r.start == (0 if r.parent is None else n[r.parent].start + n[r.parent].length)
    check_intervals(n)


def check_intervals(n):
    """The nodes whose interval holds a node's offset are its ancestors and itself."""
    for r in n.values():
        path, at = set(), r.node
        while at:
            path.add(at)
            at = n[at].parent
        assert {x.node for x in n.values() if x.offset <= r.offset < x.until} == path


def test_random_trees(spark):
    rng = random.Random(9)
    rows = []
    for c in range(300):
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c if c % 50 else None, t, "user", rng.choice("ab") * 3))
    nodes, chains = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    n = {r.node: r for r in nodes.collect()}
    order = sorted(n.values(), key=lambda r: r.offset)
    assert [r.offset for r in order] == [sum(x.length for x in order[:k]) for k in range(len(order))]
    check_intervals(n)
    turns = collections.Counter(r[0] for r in rows)
    by = collections.defaultdict(list)
    for r in chains.join(chat.ancestors(nodes, chains), "at").collect():
        by[r.conv_id].append((n[r.node].start, r.node))
    assert {c: len(p) for c, p in by.items()} == turns
    for path in by.values():
        path = [x for _, x in sorted(path)]
        assert [n[x].parent for x in path] == [None, *path[:-1]]


def test_turns_come_from_the_layout(spark):
    """Places, intervals and positions that are wrong give wrong turns."""
    from pyspark.sql import functions as F

    nodes, chains = chat.format_chats(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    digests = lambda laid: {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.with_digests(chat.read_back(laid, chains)).collect()}
    right, zero = digests(nodes), F.lit(0).cast("bigint")
    assert len(right) == 6
    for column, wrong in (("offset", zero), ("until", zero), ("start", -F.col("start"))):
        assert digests(nodes.withColumn(column, wrong)) != right


def test_tokens(spark):
    from lineagelake.llm.queries import byte_bpe_50k

    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    nodes, chains = chat.format_chats(df, byte_bpe_50k())
    n = {r.node: r for r in nodes.collect()}
    assert all(len(r.ids) == 4 * r.length for r in n.values())
    order = sorted(n.values(), key=lambda r: r.offset)
    assert [r.offset for r in order] == [sum(x.length for x in order[:k]) for k in range(len(order))]
    assert all(r.start == (0 if r.parent is None else n[r.parent].start + n[r.parent].length) for r in n.values())
    check_intervals(n)
    plain = sorted(map(str, chat.with_digests(chat.read_back(*chat.format_chats(df))).collect()))
    assert sorted(map(str, chat.with_digests(chat.read_back(nodes, chains)).collect())) == plain


def test_a_long_conversation_takes_linear_time(spark):
    import time

    rows = [(1, t, "user", f"turn {t}") for t in range(20_000)] + [(2, t, "user", f"turn {t}") for t in range(10_000)] + [(None, 0, "user", "x")] * 3000
    began = time.perf_counter()
    got = {r.conv_id: r for r in chat.with_digests(chat.read_back(*chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert time.perf_counter() - began < 60
    assert [got[k].n_turns for k in (1, 2, None)] == [20_000, 10_000, 3000]
    assert got[2].turns_sha256 == hashlib.sha256("".join(f"user\nturn {t}\n" for t in range(10_000)).encode()).hexdigest()


def test_marks_never_occur_in_texts(spark):
    nodes, _ = chat.format_chats(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    for r in nodes.collect():
        assert r.body.endswith(chat.TURN_END) and r.body.count(chat.TURN_END) == 1 and chat.ROLE_OPEN not in r.body


def test_empty_table(spark):
    nodes, chains = chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.with_digests(chat.read_back(nodes, chains)).count() == 0
