"""Byte-level BPE encoding and decoding with DuckDB's recursive queries, per partition.

``encode`` cuts each text where a single space stands between two other characters.
Every match of a pre-tokenizer of this family (optional leading space, then letters,
digits or others; white space apart) ends there, so a cut piece has the same words
wherever it occurs: Arrow cuts and numbers the distinct pieces of some megabytes of text, and each is
looked up in a bounded cache.  Texts with other white space are matched whole.  New words go
to DuckDB: token-position rows join the merge table, each word's leftmost pair of least
rank is contracted, and the query recurs until no word has a pair left.

A word of more than ``LONG`` bytes (an unbroken run of letters) is contracted in blocks, all in
one query, and the tokens around each seam are contracted again together.  That is exact:
a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding
of theirs (the first contraction across a border would also be the first of the two neighbours alone), and
the neighbours at the edges of the seams are checked; where one fails, blocks grow.

``decode`` joins token-position rows with the vocabulary and concatenates the byte
strings by an ordered aggregate.
"""

from __future__ import annotations

import base64
import gc
import itertools
import sys
import types
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Cached pieces and words of a worker, and their characters; beyond, those that were not met since the last time go.
MAX_CACHED, MAX_CACHED_CHARS = 400_000, 16_000_000
#: Bytes of text, about, that are encoded at once.
GROUP_BYTES = 4 << 20
#: Bytes from which a word is contracted in blocks, of at least so many; tokens contracted again on each side of a seam.
LONG, SEAM = 256, 8
#: Token rows that one decoding query takes, and of one document that one aggregate row takes.
DECODE_ROWS, PART_ROWS = 400_000, 100_000
DUCKDB_SETTINGS = {"threads": 1, "memory_limit": "400MB"}

#: Letters of the pre-tokenizer's letter class in every version of Unicode: such a piece is one word.
ONE_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"

CONTRACT = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
  SELECT word, toks FROM start
  UNION ALL
  SELECT state.word, list_concat(list_append(state.toks[:best.spot - 1], best.merged), state.toks[best.spot + 2:])
  FROM state JOIN (
    SELECT word, min((m.merged::BIGINT << 32) + spot) AS packed, (packed >> 32)::INT AS merged, (packed & 4294967295)::INT AS spot
    FROM (SELECT word, (unnest(toks[:-2])::BIGINT << 32) + unnest(toks[2:]) AS pair, unnest(range(1, len(toks))) AS spot FROM state WHERE len(toks) > 1) rows_at
    JOIN merges m ON m.pair = rows_at.pair
    GROUP BY word) best ON state.word = best.word
)
SELECT word, toks FROM state ORDER BY word"""

DECODE = "SELECT part, array_to_string(list(piece ORDER BY spot), '') AS bytes FROM tokens JOIN vocab USING (id) GROUP BY part ORDER BY part"


def load_ranks(path: str) -> bytes:
    """The bytes of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Words:
    """Token ids of words, in one flat array."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.met = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.chars = 0

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append new ``keys``, whose ids follow one another in ``ids``."""
        n, m = len(self.at), len(keys)
        while n + m > len(self.start):
            self.start, self.length, self.met = (np.resize(x, 2 * len(x)) for x in (self.start, self.length, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + m] = lengths
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.met[n : n + m] = False
        self.used += len(ids)
        self.chars += sum(map(len, keys))
        self.at.update(zip(keys, range(n, n + m)))

    def gather(self, which: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        self.met[which] = True
        length = self.length[which]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[which] - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def trimmed(self) -> Words:
        """The words met since the last trim; none if they alone are too many."""
        kept = Words()
        which = np.flatnonzero(self.met[: len(self.at)])
        words = list(self.at)
        words = [words[k] for k in which.tolist()]
        if len(words) <= MAX_CACHED // 2 and sum(map(len, words)) <= MAX_CACHED_CHARS // 2:
            kept.add(words, self.gather(which), self.length[which])
        return kept


class Encoder:
    """Encodes texts of one worker; caches words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.space = {chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c))}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config=DUCKDB_SETTINGS)
        self.db.execute("SET temp_directory = ''")
        pairs, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32) + b)
                    merged.append(rank)
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.words = Words()

    def _plain(self, piece: str) -> bool:
        """Whether a piece of the quick split (before every space) has the words it would have within its text."""
        body = piece.removeprefix(" ")
        return bool(body) and body[-1] not in self.space and body[0] not in self.space

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts, one after the other (uint32), and where each text's begin and the last's end."""
        if len(self.words.at) > MAX_CACHED or self.words.chars > MAX_CACHED_CHARS:
            self.words = self.words.trimmed()
        texts = pc.fill_null(texts, "")
        quick = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        coded = quick.flatten().dictionary_encode()
        pieces, index, ends = coded.dictionary, coded.indices.to_numpy(), quick.offsets.to_numpy() - quick.offsets[0].as_py()
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.words.at.get, names))
        new = [k for k, x in enumerate(at) if x is None]
        one_word = pc.match_substring_regex(pieces.take(pa.array(new, pa.int64())), ONE_WORD).to_numpy(zero_copy_only=False).tolist()
        odd = {k for k, w in zip(new, one_word) if not w and not self._plain(names[k])}
        self._learn([names[k] for k, w in zip(new, one_word) if w], [names[k] for k, w in zip(new, one_word) if not w and k not in odd])
        for k in new:
            at[k] = -1 if k in odd else self.words.at[names[k]]
        which, length = np.array(at, np.int64)[index], np.diff(ends)
        # a text that holds "\0" has pieces that do not begin with a space
        strange = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        if odd:
            strange |= np.bincount(np.repeat(np.arange(len(length)), length), which < 0, len(length)) > 0
        if strange.any():
            parts = np.split(which, ends[1:-1])
            words = {int(i): self.pattern.findall(texts[int(i)].as_py()) for i in np.flatnonzero(strange)}
            self._learn(list({w: None for found in words.values() for w in found if w not in self.words.at}), [])
            for i, found in words.items():
                parts[i] = np.array([self.words.at[w] for w in found], np.int64)
            which, length = np.concatenate(parts), np.array(list(map(len, parts)))
        tokens = np.concatenate(([0], np.cumsum(self.words.length[which])))
        return self.words.gather(which), tokens[np.concatenate(([0], np.cumsum(length)))]

    def _learn(self, words: list[str], pieces: list[str]) -> None:
        """Add new words, and new pieces of one word or more."""
        split = [self.pattern.findall(p) for p in pieces]
        if split:
            known = dict.fromkeys(words)
            words = [*words, *{w: None for ws in split for w in ws if w not in self.words.at and w not in known}]
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        direct = [(w, self.ranks[d]) for w, d in zip(words, data) if d in self.ranks]
        self.words.add([w for w, _ in direct], np.array([r for _, r in direct], np.uint32), np.ones(len(direct), np.int64))
        rest = [(w, d) for w, d in zip(words, data) if d not in self.ranks]
        short = [(w, d) for w, d in rest if len(d) <= LONG]
        if short:
            ids, ends = self._contract([d for _, d in short])
            self.words.add([w for w, _ in short], ids, np.diff(ends))
        for w, d in rest:
            if len(d) > LONG:
                ids = self._contract_long(d)
                self.words.add([w], ids, np.array([len(ids)]))
        several = [(p, ws) for p, ws in zip(pieces, split) if p not in self.words.at]
        if several:
            at = np.array([self.words.at[w] for _, ws in several for w in ws], np.int64)
            ends = np.cumsum([0] + [len(ws) for _, ws in several])
            tokens = np.concatenate(([0], np.cumsum(self.words.length[at])))
            self.words.add([p for p, _ in several], self.words.gather(at), np.diff(tokens[ends]))

    def _each(self, words: list[bytes]) -> list[np.ndarray]:
        distinct = list(dict.fromkeys(words))
        ids, ends = self._contract(distinct)
        found = dict(zip(distinct, np.split(ids, ends[1:-1])))
        return [found[w] for w in words]

    def _contract_long(self, word: bytes, block: int = LONG) -> np.ndarray:
        while block < len(word):
            parts = self._each([word[at : at + block] for at in range(0, len(word), block)])
            joined = self._join(parts) if min(map(len, parts[:-1])) > 2 * SEAM else None
            if joined is not None:
                return joined
            block *= 8
        return self._each([word])[0]

    def _join(self, parts: list[np.ndarray]) -> np.ndarray | None:
        """The blocks' tokens with those around each seam contracted again; None if two
        neighbours at a seam's edge are not the encoding of their bytes."""
        text = lambda ids: b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        seams = self._each([text(a[-SEAM:]) + text(b[:SEAM]) for a, b in itertools.pairwise(parts)])
        edges = [np.array((a[-SEAM - 1], s[0])) for a, s in zip(parts, seams)] + [np.array((s[-1], b[SEAM])) for s, b in zip(seams, parts[1:]) if len(b) > SEAM]
        if not all(map(np.array_equal, edges, self._each(list(map(text, edges))))):
            return None
        out = [parts[0][:-SEAM]]
        for s, b in zip(seams, parts[1:]):
            out += [s, b[SEAM:-SEAM]]
        out[-1] = parts[-1][SEAM:]
        return np.concatenate(out)

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        start = pa.table({"word": pa.array(np.arange(len(words), dtype=np.int32)), "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))})
        self.db.register("start", start)
        toks = self.db.sql(CONTRACT).to_arrow_table().column("toks").combine_chunks()
        self.db.unregister("start")
        return toks.values.to_numpy(zero_copy_only=False).astype(np.uint32), toks.offsets.to_numpy()


def _kept(name: str, sent: Broadcast, make):
    """State that lives as long as a Python worker, over its tasks: made once for each broadcast value."""
    state = sys.modules.setdefault("_lineagelake_worker", types.ModuleType("_lineagelake_worker"))
    key, value = getattr(state, name, (None, None))
    if key != hash(sent.value):
        key, value = hash(sent.value), make()
        setattr(state, name, (key, value))
    return value


def _encoding(sent: Broadcast):
    """Batches (id, text) to batches (id, ids)."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        gc.disable()  # many small objects are made, none of them in cycles
        encoder = _kept("encoder", sent, lambda: Encoder(parse_ranks(sent.value[0]), sent.value[1]))
        names, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        ids, ends = encoder.encode(texts)
        data = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
        return pa.RecordBatch.from_arrays([names, data.cast(pa.binary())], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= GROUP_BYTES:
                yield done(held)
                held = []
        if held:
            yield done(held)

    return run


def _vocabulary(ranks: dict[bytes, int]) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect(config=DUCKDB_SETTINGS)
    db.execute("SET temp_directory = ''")
    # bytes as the characters U+0000 to U+00FF, for the string aggregate
    db.register("given", pa.table({"id": pa.array(ranks.values(), pa.uint32()), "piece": [t.decode("latin-1") for t in ranks]}))
    db.execute("CREATE TABLE vocab AS SELECT * FROM given")
    db.unregister("given")
    return db


def _decoding(sent: Broadcast):
    """Batches (id, ids) to batches (id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            db = _kept("decoder", sent, lambda: _vocabulary(parse_ranks(sent.value[0])))
            ids = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
            out: list[list[bytes]] = [[] for _ in ids]
            group: list[tuple[int, np.ndarray]] = []
            held = 0
            for k, x in enumerate(ids):
                for at in range(0, len(x), PART_ROWS):
                    group.append((k, x[at : at + PART_ROWS]))
                    held += len(group[-1][1])
                    if held >= DECODE_ROWS:
                        _join_bytes(db, group, out)
                        group, held = [], 0
            _join_bytes(db, group, out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b"".join(x) for x in out], pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def _send(df: DataFrame, ranks_path: str, pattern: str) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; ids: little-endian unsigned 32-bit token ids.

    Each match of ``pattern`` is encoded on its own, a match that is a token at once;
    there are no special tokens.  Null and empty texts give no ids.  Repeated rows are
    encoded like others; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), _encoding(_send(docs, ranks_path, pattern)), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; no ids give no bytes."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), _decoding(_send(encoded, ranks_path, "")), f"doc_id {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task needs one Python worker, not two."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = _send(docs, ranks_path, pattern)
    there, back = _encoding(sent), _decoding(sent)
    return map_batches(docs.select("doc_id", "text"), lambda batches: back(there(batches)), f"doc_id {kind}, ids binary, decoded binary")


def _join_bytes(db: duckdb.DuckDBPyConnection, group: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
    if not group:
        return
    ids = np.concatenate([x for _, x in group])
    part = np.repeat(np.arange(len(group), dtype=np.int32), [len(x) for _, x in group])
    db.register("tokens", pa.table({"part": part, "spot": np.arange(len(ids), dtype=np.int32), "id": ids}))
    found = db.sql(DECODE).to_arrow_table()
    db.unregister("tokens")
    for p, s in zip(found.column("part").to_pylist(), found.column("bytes").to_pylist()):
        out[group[p][0]].append(s.encode("latin-1"))


def with_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``decode`` returns."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
