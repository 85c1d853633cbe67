import base64
import collections
import hashlib

import pytest

from lineagelake.llm import warc

NASTY = [(1, "u", "a\r\n\r\nWARC/1.1\r\nx" * 5), (2, None, None), (3, "u", ""), (4, "u\r\nX: y", "é😀" * 1000), (5, "u", "é😀" * 1000), (6, "u", "\r\n\r\n"), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "WARC/1.1\r\n"), (9, "u", "x\r\n"), (10, "u", "\n\n\r\n\r\n\r\n"), (11, "u", "x\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n"), (-3, "u", "neg")]


def expected(rows):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -99), i)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    return sorted((i, len((h or "").encode()), digest(h or ""), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, _, h in rows)


def found(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_round_trip(spark, chunk):
    df = spark.createDataFrame([(*r, "x") for r in NASTY], "page_id long, url string, html string, bytes string")
    assert found(warc.round_trip(df, chunk_bytes=chunk)) == expected(NASTY)


def test_repeats_hot_payload_and_small_ones(spark):
    rows = NASTY + NASTY[:6] + [(20, "u", "")] * 3 + [(30 + k, "u", "hot payload") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = found(warc.round_trip(df))
    bare = lambda rs: collections.Counter((r[0], r[1], r[2]) for r in rs)
    assert bare(got) == bare(expected(rows))
    assert sum(r[3] == "response" for r in got) == len({h or "" for _, _, h in rows})
    assert {r[4] for r in got if r[1] == len("hot payload")} == {None, 329}
    small = found(warc.round_trip(df, min_bytes=10))
    assert all(r[3] == "response" for r in small if r[1] < 10) and len(small) == len(rows)


def test_payloads_over_a_chunk(spark):
    """Payloads of several default chunks, with marks and long characters at the borders."""
    big = "é😀x" * 90_000
    rows = [(1, "u", big), (2, "u", big), (3, "u", "a" * (warc.CHUNK_BYTES - 4) + "\r\n\r\nWARC/1.1\r\n" + big), (4, None, "b" * (1 << 20)), (5, "u", "😀" * 65_536)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert found(warc.round_trip(df)) == expected(rows)
    chunks = warc.chunk_table(df).where("page_id = 4").orderBy("chunk").collect()
    assert [r.chunk for r in chunks] == [0, 1, 2, 3] and [r["last"] for r in chunks] == [False] * 3 + [True]
    assert [r.size for r in chunks] == [warc.CHUNK_BYTES * k for k in range(1, 5)] and all(len(r.piece) == warc.CHUNK_BYTES for r in chunks)
    assert [r.digest is None for r in chunks] == [True] * 3 + [False]


@pytest.mark.parametrize("chunk", [1, 2, 5, 64])
def test_pieces_are_whole_and_free_of_marks(chunk):
    for text in ["", "é😀" * 20, "WARC/1.1\r\n" * 3, "x" * 63 + "WARC/1.1\r\n", "WWARC/1.1\r\n中"]:
        data = text.encode()
        out = [bytes(p) for p in warc.pieces_of(memoryview(data), chunk)]
        assert b"".join(out) == data and all(p.decode() is not None and len(p) <= max(chunk, 4) and b"WARC/1.1\r\n" not in p for p in out)


def test_every_record_is_dated_and_identified(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    warc.write_archive(spark.createDataFrame(NASTY, "page_id long, url string, html string"), path, chunk_bytes=4, date="2020-02-03T04:05:06Z")
    heads = [r.value for r in spark.read.option("lineSep", warc.END + warc.VERSION).text(path).collect()]
    assert all("WARC-Date: 2020-02-03T04:05:06Z\r\n" in h for h in heads)
    ids = [h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads]
    assert len(set(ids)) == len(ids) > len(NASTY)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_are_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x", "abcdefgh")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(df, path, chunk_bytes=3)
    rows = warc.read_chunks(spark, path).orderBy("chunk").collect()
    assert [(r.type, r.chunk, bytes(r.payload)) for r in rows] == [("response", 1, b"abc"), ("continuation", 2, b"def"), ("continuation", 3, b"gh")]
    assert len({r.record for r in rows}) == 1
