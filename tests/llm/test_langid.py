import zlib

import numpy as np
import pytest

from lineagelake.llm import langid
from lineagelake.llm.common import read


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")


@pytest.fixture(scope="module")
def net(docs):
    return langid.fit(docs)


def test_held_out_accuracy(docs, net):
    p = langid.identify(docs, net).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id]).all()
    out = p[p.held_out & (p.lang_pred != "und")]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97
    assert p.score.between(0, 1).all()


def test_only_the_text_decides(spark, net):
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "der und nicht die Schule ist"), (None, "der und nicht die Schule ist"), (4, "der und nicht die Schule ist")]
    df = spark.createDataFrame([(i, t, "zz", "src", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, score double")
    got = langid.identify(df, net).collect()
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3
    assert len({(r.lang_pred, r.score) for r in got[3:]}) == 1 and got[3].lang_pred in net.langs
    kept = langid.keep_identified(df, net)
    assert kept.columns == df.columns and kept.count() == 3


def test_long_text_equals_its_windows(net):
    text = "the and of that with this " * 20_000
    assert net.predict([text])[0] == net.predict([text[:260]])[0]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    net = langid.fit(df)
    assert [(r.lang_pred, r.score) for r in langid.identify(df, net).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0), net).count() == 0


def test_probabilities_equal_a_plain_loop(net):
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    for row, got in zip(x, net.probabilities(x)):
        pooled = []
        for table in net.tables:
            for f in range(langid.FILTERS):
                pooled.append(max(sum(float(table[j][row[at + j]][f]) for j in range(len(table))) for at in range(langid.WINDOW - len(table) + 1)))
        hidden = np.maximum(np.array(pooled) + net.bias, 0)
        z = hidden @ net.dense.astype(float) + net.offset
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got, want, atol=1e-5)


def test_training_follows_the_gradient(monkeypatch):
    """One step from the start moves every parameter against the slope that finite differences give."""
    monkeypatch.setattr(langid, "WINDOW", 12)
    monkeypatch.setattr(langid, "FILTERS", 2)
    windows, labels = [b"abcabcabcabc", b"xyzxyzxyzxyz", b"abcxbcabcabc"], ["a", "x", "a"]
    start = langid.train(windows, labels, epochs=0)
    after = langid.train(windows, labels, epochs=1, batch=3, rate=1e-4)
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, 12)
    y, weight = np.array([0, 1, 0]), np.array([0.75, 1.5, 0.75])
    loss = lambda: float(-(weight * np.log(start.probabilities(x)[np.arange(3), y])).mean())
    checked = 0
    for param, moved in ((start.dense, after.dense), (start.offset, after.offset), (start.bias, after.bias)):
        for at in np.ndindex(param.shape):
            kept, e = param[at], np.float32(1e-2)
            param[at] = kept + e
            up = loss()
            param[at] = kept - e
            slope = (up - loss()) / (2 * e)
            param[at] = kept
            if abs(slope) > 1e-3:
                assert np.sign(moved[at] - kept) == -np.sign(slope)
                checked += 1
    assert checked > 5


def test_the_sample_keeps_every_language_and_ignores_order(spark):
    rows = [(k % 5 or None, f"text number {k} of many", f"l{k % 300}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = langid.sample_windows(df, per_lang=2)
    assert first == langid.sample_windows(df.repartition(7), per_lang=2)
    assert len({lang for lang in langid.sample_windows(df, per_lang=10)[1]}) == len({r[2] for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2})


def test_repeated_rows_and_null_ids_enter_the_sample_once(spark):
    df = spark.createDataFrame([(None, "the same text", "en")] * 500, "doc_id long, text string, lang string")
    assert len(langid.sample_windows(df)[0]) == 1
