import hashlib
import re

from lineagelake.llm import secret_scan

PATTERNS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[g]) >= n]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{z}" for a, k, z in sorted(found))


KEY = "AKIA" + "Q7" * 8
HEX = "0123456789abcdef" * 2
TEXTS = [None, "", "no secrets", f"é😀 token = '{HEX}' {KEY}", 'PassWord:"short" passwd=longer_value', "token=token=abcdef", f"{HEX}{HEX} {HEX[:23]}", "api_key : x.y/z=w", "apikey=a", "secret=" + "A" * 5 + " secret=" + "A" * 6, "AKIA" + "A" * 15, f"{KEY}{KEY}", "token=abc token=abcdef\ntoken =   ghijkl", "x" * 50_000 + " secret: " + "s" * 3000]


def test_base_equals_regular_expressions(spark):
    df = spark.createDataFrame([(k, t, "own", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, source string, row int")
    got = {r.doc_id: r for r in secret_scan.with_digests(secret_scan.scan(df)).collect()}
    for k, t in enumerate(TEXTS):
        want = base_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(want.count(f"{n}:") for n, *_ in PATTERNS)
        assert got[k].spans == want


def test_ownership_decides_shapes(spark):
    mine, shared = "ghp_" + "a1B2" * 9, "ghp_" + "Zz99" * 9
    rows = [(1, f"x {mine} y", "ann"), (2, f"{mine}", "ann"), (3, f"see {shared}", "ann"), (4, f"see {shared}", "bob"), (4, f"see {shared}", "bob"), (5, f"{mine} {mine}", None)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = sorted((r.doc_id, r.spans, r.n_copied, r.n_owned) for r in got)
    assert by[0] == (1, "github:2:42", 0, 1) and by[2] == (3, "", 1, 0)
    assert by[3] == by[4] == (4, "", 1, 0) and by[5][1] == "github:0:40,github:41:81"


def test_redaction(spark):
    rows = [(1, f"a token = '{HEX}' b", "s", 99), (2, None, "s", None), (3, "clean", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert got[1].text == "a [SECRET]' b" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3] == df.where("doc_id = 3").first()
    assert secret_scan.redact(df.limit(0)).columns == df.columns


def test_an_owners_copies_stay_secret_however_many(spark):
    mine, shared = "ghp_" + "a1B2" * 9, "ghp_" + "Zz99" * 9
    rows = [(k, f"x {mine} y", "ann") for k in range(150)] + [(k, shared, "ann" if k % 2 else "bob") for k in range(150, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.spans, r.n_copied, r.n_owned) for r in secret_scan.scan(df).collect()}
    assert all(got[k] == ("github:2:42", 0, 1) for k in range(150)) and all(got[k] == ("", 1, 0) for k in range(150, 300))
    assert {r.text for r in secret_scan.redact(df).where("doc_id < 150").collect()} == {"x [SECRET] y"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secret_scan.scan(df).count() == 0


def test_many_spans_take_linear_time(spark):
    import time

    text = " ".join(f"{k:032x}" for k in range(30_000))
    df = spark.createDataFrame([(1, text, "s"), (1, text, "s")], "doc_id long, text string, source string")
    began = time.perf_counter()
    got = secret_scan.with_digests(secret_scan.scan(df)).collect()
    assert time.perf_counter() - began < 30
    assert [r.n_hex for r in got] == [30_000] * 2 and got[0].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()
    assert {r.text for r in secret_scan.redact(df).collect()} == {" ".join(["[SECRET]"] * 30_000)}


def test_overlapping_kinds_are_redacted_once(spark):
    rows = [(1, f"token={HEX}-tail end", "s"), (2, f"{HEX}", "s"), (3, "", "s")]
    got = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: "[SECRET] end", 2: "[SECRET]", 3: ""}


def test_rows_without_a_place_of_their_own(spark, sf_dir):
    """Rows that an explode repeats are redacted each once."""
    from pyspark.sql import functions as F

    from lineagelake.llm.common import read

    docs = read(spark, sf_dir, "documents")
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert secret_scan.redact(twice).count() == 2 * docs.count()


def test_each_count_matters(spark):
    """Owners alone, repositories alone and both: taking either away changes the spans."""
    one, two, three = "4929" * 4, "5150" * 4, "6011" * 4
    rows = [(k, f"no {one}", "ann") for k in range(6)] + [(10, f"no {two}", "ann"), (11, f"no {two}", "bob")] + [(20, f"no {three}", "cy"), (20, f"no {three}", "cy"), (21, f"no {three}", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = lambda **bounds: {r.doc_id: r.spans for r in secret_scan.scan(df, **bounds).collect()}
    both, owners, repos = spans(max_repos=5), spans(max_repos=100), spans(max_owners=9, max_repos=5)
    mine = {20: "account:3:19", 21: "account:3:19"}
    assert both == dict.fromkeys([*range(6), 10, 11], "") | mine
    assert owners == dict.fromkeys(range(6), "account:3:19") | {10: "", 11: ""} | mine
    assert repos == dict.fromkeys(range(6), "") | dict.fromkeys([10, 11], "account:3:19") | mine
    got = {r.doc_id: (r.most_owners, r.most_repos) for r in secret_scan.scan(df).collect()}
    assert got[0] == (1, 6) and got[10] == (2, 2) and got[20] == (1, 2)


def test_logins_in_addresses(spark):
    df = spark.createDataFrame([(1, "at ftp://me:pa55@host/x and http://h:80/y", "s")], "doc_id long, text string, source string")
    assert secret_scan.scan(df).first().spans == "login:3:17"
