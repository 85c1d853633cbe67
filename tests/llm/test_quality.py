import collections
import re

from lineagelake.llm import quality

LINE = "one two three four five six seven eight nine ten"
TEXTS = [None, "", " \n\t", LINE, LINE + "\n" + LINE, "\n".join([LINE] * 30), "a " * 40, "## $$ %% " * 30, "same\nsame\n \nother\nsame", "é😀 ß " * 9, "UPPER WORDS " * 30, "12 34 56 " * 20, " ".join(f"word{k}" for k in range(5000)), "x" * 100_000]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(win)
    again = {p for i, x in enumerate(win) if count[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(TEXTS)], "doc_id long, text string, kept boolean")
    for r in quality.cascade(df).collect():
        want = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_order_never_changes_the_verdict(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    verdict = lambda rules: sorted((r.doc_id, r.kept) for r in quality.assess(df, rules).collect())
    assert verdict(list(quality.RULES)) == verdict(list(reversed(quality.RULES)))


def test_cheap_selective_rules_come_first(spark):
    calls = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(25))) for k in range(200)], "doc_id long, text string")
    slow = quality.Rule("slow", lambda d: sum(range(20_000)) < 0)
    none = quality.Rule("never rejects", lambda d: True)
    quick = quality.Rule("quick", lambda d: False)
    assert [r.name for r, _, _ in quality.order_rules(calls, (none, slow, quick))] == ["quick", "slow", "never rejects"]


def test_empty_table(spark):
    assert quality.cascade(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_sample_is_drawn_by_row(spark):
    """One hot text, or null, is neither taken whole nor left out."""
    seen = spark.sparkContext.accumulator(0)
    text = " ".join(f"w{j}" for j in range(25))
    df = spark.createDataFrame([(k, text if k % 2 else None) for k in range(20_000)], "doc_id long, text string")
    count = quality.Rule("count", lambda d: seen.add(1) is None)
    quality.order_rules(df, (count,), sample_rows=500)
    assert 150 < seen.value < 400


def test_shared_measures_cost_nothing(spark):
    """A rule over measures that every text has anyway is cheap, one with measures of its own is not."""
    text = "\n".join(" ".join(f"word{k}x{j}" for j in range(40)) for k in range(100))
    df = spark.createDataFrame([(k, text) for k in range(50)], "doc_id long, text string")
    cost = {r.name: ns for r, ns, _ in quality.order_rules(df)}
    assert cost["symbols"] * 20 < cost["letters"] and cost["duplicate_lines"] * 20 < cost["top_pair"]


def test_rules_equal_plain_ratios(spark):
    lines = lambda x: "\n".join(f"{x[0]}some words number{k} and more of them{x[1]}" for k in range(10))
    texts = [lines(("", "")), lines(("- ", "")), lines(("", "...")), "1a " + "22 333 4444 " * 9 + "x y z", " ".join(f"{k} {k + 1}" for k in range(10, 60)), "word " * 7 + " ".join(f"unlike{k}" for k in range(40)), lines(("", ""))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.cascade(df).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True}
