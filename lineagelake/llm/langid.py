"""Language identification with a byte convolutional network.

The network reads windows of ``WINDOW`` bytes: filters of several widths over one-hot
bytes (so a filter is a table look-up per position), max pooling over the window, and a
softmax.  It is trained in numpy, on the driver, on a bounded sample of labelled rows
(about ``per_lang`` documents of each language, ``WINDOWS_PER_DOC`` windows of each) and applied
to every window of every text.  No language is left out, so the sample grows with the number of
languages alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
WINDOWS_PER_DOC = 4
#: Bound of the training sample: documents of each language.
PER_LANG = 400
UNKNOWN = "und"
_LOWER = bytes(range(256)).lower()


@dataclass
class ByteCnn:
    """Filters ``tables[w][j]`` (256 x FILTERS: byte at offset j), a bias each, and the softmax layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False):
        """Max-pooled filter values of windows ``x`` (n x WINDOW bytes), and the positions if asked."""
        best, at = [], []
        for table in self.tables:
            width = len(table)
            span = x.shape[1] - width + 1
            value = np.take(table[0], x[:, :span], axis=0)
            for j in range(1, width):
                value += np.take(table[j], x[:, j : j + span], axis=0)
            if where:
                at.append(value.argmax(axis=1))
            best.append(value.max(axis=1))
        best = np.concatenate(best, axis=1) + self.bias
        return (best, np.concatenate(at, axis=1)) if where else best

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        # in double precision, so that a text's score does not depend on its neighbours
        return _softmax(np.maximum(self.pooled(x), 0).astype(np.float64) @ self.dense.astype(np.float64) + self.offset)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability (mean over a text's windows, by their bytes) of each text."""
        data = [t.encode("utf-8", "surrogatepass").translate(_LOWER) if t and any(map(str.isalpha, t)) else b"" for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for owner, weight, block in _windows(data):
            np.add.at(total, owner, self.probabilities(block) * weight[:, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        best = total.argmax(axis=1)
        return [self.langs[k] if d else UNKNOWN for k, d in zip(best, data)], [round(float(min(total[i, k], 1.0)), 9) if d else 0.0 for i, (k, d) in enumerate(zip(best, data))]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _windows(data: list[bytes], block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of all texts in blocks: (index of the text, bytes that count, zero-padded window)."""
    owner, weight, rows = [], [], []
    for i, d in enumerate(data):
        for at in range(0, len(d), WINDOW):
            piece = d[at : at + WINDOW]
            owner.append(i)
            weight.append(len(piece))
            rows.append(piece if len(piece) == WINDOW else piece.ljust(WINDOW, b"\0"))
            if len(rows) == block:
                yield np.array(owner), np.array(weight, np.float64), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)
                owner, weight, rows = [], [], []
    if rows:
        yield np.array(owner), np.array(weight, np.float64), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)


def train(windows: list[bytes], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Fit the network with Adam; a language's windows weigh as much as another's."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    pooled = FILTERS * len(WIDTHS)
    net = ByteCnn(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(pooled, np.float32), rng.normal(0, 0.3, (pooled, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    if len(langs) == 0:
        return net
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0")[:WINDOW] for w in windows), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(langs, labels)
    weight = (1 / np.bincount(y, minlength=len(langs)))[y]
    weight /= weight.mean()
    params = [*net.tables, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            bx = x[pick]
            raw, where = net.pooled(bx, where=True)
            hidden = np.maximum(raw, 0)
            err = _softmax(hidden @ net.dense + net.offset)
            err[np.arange(len(pick)), y[pick]] -= 1
            err *= (weight[pick] / len(pick))[:, None].astype(np.float32)
            back = (err @ net.dense.T) * (raw > 0)
            grads = []
            rows = np.arange(len(pick))[:, None]
            for k, table in enumerate(net.tables):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(table)
                for j in range(len(table)):
                    np.add.at(grad[j], (bx[rows, where[:, cols] + j], np.arange(FILTERS)[None, :]), back[:, cols])
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ err, err.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def sample_windows(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[bytes], list[str]]:
    """Training windows: about ``per_lang`` documents of each language (all, of a rarer one), chosen by a
    hash of id and text over the whole table, and windows at hashed places of their whole texts.

    Equal rows count as one.  Each text falls into the sample on its own, with chance ``per_lang`` over the
    language's rows, so twice ``per_lang`` is never met in practice, nothing is cut off, and the order of
    rows does not matter.
    """
    known = docs.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"), "text", "lang")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return [], []
    share = F.create_map([F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_lang / r["count"]))])
    chosen = known.where(F.col("h") < share[F.col("lang")] * (1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
                if not any(map(str.isalpha, text)):
                    continue
                starts = range(0, len(data), WINDOW)
                for k in range(min(WINDOWS_PER_DOC, len(starts))):
                    at = starts[(h * 2654435761 + k * len(starts) // WINDOWS_PER_DOC) % len(starts)]
                    out.append((h, lang, data[at : at + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary())], names=["h", "lang", "win"])

    rows = sorted({(r["h"], r["lang"], bytes(r["win"])) for r in map_batches(chosen.select("h", "text", "lang"), run, "h bigint, lang string, win binary").distinct().collect()})
    return [r[2] for r in rows], [r[1] for r in rows]


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> ByteCnn:
    """Train on ``docs`` (doc_id, text, lang): rows that are not held out and have a language."""
    return train(*sample_windows(docs, per_lang))


def identify(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row's whole text.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if the
    network knows no language.  Only the text decides; ties go to the first language in
    alphabetical order.  Repeated rows are judged like others, a null doc_id too; a text of any
    length is read to its end, a few windows at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteCnn, min_score: float = 0.3) -> DataFrame:
    """The rows, unchanged, whose language is known with at least ``min_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.predict(b.column(place).to_pylist())
            yield b.filter(pa.array([p != UNKNOWN and s >= min_score for p, s in zip(lang, score)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
