"""The pipeline's decisions against plain Python on the smallest tables."""

import hashlib

import numpy as np
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lineagelake.llm import bpe, langid, simhash  # noqa: E402
from lineagelake.llm.common import materialize, read  # noqa: E402


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen[name] = docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first = seen["language_id"]
    net = langid.fit(start)
    lang = dict(zip(start.toPandas().doc_id, zip(*net.predict(start.toPandas().text.tolist()))))
    assert set(first.doc_id) == {d for d, (p, s) in lang.items() if p != "und" and s >= 0.3}
    fps = {d: np.uint64(simhash.fingerprint(t) & ((1 << 64) - 1)) for d, t in zip(first.doc_id, first.text)}
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if np.bitwise_count(fps[a] ^ fps[b]) <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(seen["simhash_dedup"].doc_id) == {d for d in ids if root(d) == d}
    sh = lambda t: {b" ".join(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(max(len(w) - 4, 1))}
    items = [sh(t) for t in read(spark, sf_dir, "benchmark").toPandas().text]
    clean = {d for d, t in zip(seen["simhash_dedup"].doc_id, seen["simhash_dedup"].text) if not any(len(q & sh(t)) >= 0.8 * len(q) - 1e-9 for q in items)}
    assert set(seen["decontamination"].doc_id) == clean == set(seen["secret_scan"].doc_id)
    path, pattern = corpus_pipeline.byte_bpe_50k()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(bpe.load_ranks(path)), special_tokens={})
    text = dict(zip(seen["secret_scan"].doc_id, seen["secret_scan"].text))
    for r in seen["byte_bpe"].itertuples():
        ids = np.array(library.encode_ordinary(text[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf_dir).count() == len(clean)


def write(spark, folder, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int"
    spark.createDataFrame([(*d, len(d[1] or ""), "r", 1) for d in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_odd_rows_go_through(spark, tmp_path):
    """Nulls, empty and letterless texts, repeated rows, null ids, secrets and columns with clashing names."""
    words = "plain words about the weather in the north of the country where rain falls often and long".split()
    text = lambda k: " ".join(words[(k * j) % len(words)] + str(k) for j in range(1, 40))
    docs = [(k, text(k), "en", "s") for k in range(30)]
    docs += [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 34 !?", None, "s"), (None, text(50), "en", None), (3, text(3), "en", "s"), (3, text(3), "en", "s"), (104, text(60) + " the quick brown fox jumps over the lazy dog again", "en", "s"), (105, text(70) + " password = hunter2hunter2", "en", "s"), (106, "long " * 20_000 + text(80), "en", "s")]
    got = corpus_pipeline.run(spark, write(spark, tmp_path, docs)).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    assert ids == [-1, *range(30), 105, 106]
    assert all(r.n_tokens > 0 and r.decoded_sha256 for r in got)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0
