import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from lineagelake.llm import bpe
from lineagelake.llm.queries import byte_bpe_50k

PATH, PATTERN = byte_bpe_50k()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.load_ranks(PATH)), special_tokens={})


def texts():
    r = random.Random(8)
    odd = ["", " ", "  a", "a  b", "a \n b", "a b ", "\n\n x", "a\0 b", "don't we'll  it's", "x" * 700, " 　 x \x85y", "\x1c \x1d a", "é😀 ü", "a\t b", "a   ", "<|endoftext|>", "ab" * 300]
    return odd + ["".join(r.choice(" ab\n\t'1é,\0中") for _ in range(50)) for _ in range(400)] + [" ".join(r.choice(["the", "tion", "Ünï", "x1y2", "…"]) for _ in range(4000))]


def encode(e, texts):
    ids, ends = e.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends[1:-1])] if texts else []


def test_equals_the_library(library):
    e = bpe.Encoder(bpe.parse_ranks(bpe.load_ranks(PATH)), PATTERN)
    for _ in range(2):  # cold and cached
        assert encode(e, texts()) == [library.encode_ordinary(t) for t in texts()]
    assert encode(e, [None, "", None]) == [[], [], []]


def test_cache_is_trimmed(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 50)
    e = bpe.Encoder(bpe.parse_ranks(bpe.load_ranks(PATH)), PATTERN)
    for t in texts()[:60]:
        assert encode(e, [t, t])[1] == library.encode_ordinary(t)
    assert len(e.words.at) < 200


def test_long_words(library, monkeypatch):
    r = random.Random(5)
    e = bpe.Encoder(bpe.parse_ranks(bpe.load_ranks(PATH)), PATTERN)
    letters = lambda n, abc: "".join(r.choice(abc) for _ in range(n))
    long = [letters(3000, "etaoins"), letters(2000, "ab"), "x" * 5000, "中文字語言" * 300, " " * 3000, "=" * 3000 + "-", "ab" * 2000 + "c", "the" * 1500, "1" * 2500]
    for w in long:
        assert encode(e, [w]) == [library.encode_ordinary(w)], w[:20]
    monkeypatch.setattr(bpe, "LONG", 24)  # many seams, some of which do not hold
    monkeypatch.setattr(bpe, "SEAM", 1)
    e = bpe.Encoder(bpe.parse_ranks(bpe.load_ranks(PATH)), PATTERN)
    for _ in range(150):
        w = letters(r.randint(25, 300), r.choice(["etaoinshr", "ab", "thean", "aeiou中é"]))
        assert encode(e, [w]) == [library.encode_ordinary(w)], w


def test_a_long_word_takes_linear_time():
    import time

    r = random.Random(6)
    e = bpe.Encoder(bpe.parse_ranks(bpe.load_ranks(PATH)), PATTERN)
    began = time.perf_counter()
    encode(e, ["".join(r.choice("etaoinshrdlu") for _ in range(100_000))])
    assert time.perf_counter() - began < 20


def test_round_trip(spark, library, monkeypatch):
    rows = list(enumerate(texts())) + [(9000, None), (None, "null id"), (3, "a repeated id")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.with_digests(bpe.decode(bpe.encode(df, PATH, PATTERN), PATH)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i or -1, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(want)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.with_digests(bpe.round_trip(df, PATH, PATTERN)).collect()) == got
    assert bpe.decode(bpe.encode(df.limit(0), PATH, PATTERN), PATH).count() == 0
