"""Quality rules as a short-circuit cascade.

Each rule reads some measures of a text and passes or rejects it.  Some measures are part of the
result and taken of every text; the others only when a rule asks for them.  A sample of the texts
that reach the cascade tells what each rule costs there (nanoseconds a document, with the
measures that only it needs) and how often it rejects; rules then run in the order of rejections per
cost, and a text that one rule rejects never meets the next.  The verdict is the conjunction of all rules, so the order (which
follows measured times) changes the work, never the result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BLANK = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
BULLET, ELLIPSIS = re.compile(r"[ \t]*[-*•]"), re.compile(r"(\.\.\.|…)[ \t\r]*\Z")
#: Documents, about, on which costs and selectivities are estimated.
SAMPLE_ROWS = 512


class Doc:
    """A text's measures, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside any window of eight words that the text holds twice or more."""
        n = len(self.words)
        if n <= REPEAT_WINDOW:
            return 0
        seen: dict[bytes, int] = {}
        rank = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        width = 1
        while width < REPEAT_WINDOW:  # equal ranks: equal windows of twice the width
            values, rank, counts = np.unique(rank[:-width] * (n + 1) + rank[width:], return_inverse=True, return_counts=True)
            if len(values) == len(rank):
                return 0
            width *= 2
        again = (counts[rank] > 1).astype(np.int64)
        edge = np.zeros(n + 1, np.int64)
        edge[: len(again)] += again
        edge[REPEAT_WINDOW : REPEAT_WINDOW + len(again)] -= again
        return int((np.cumsum(edge)[:n] > 0).sum())

    @cached_property
    def base_failed(self) -> bool:
        return len(self.words) < 20 or 100 * self.n_repeat_words > 30 * len(self.words)

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_letter_words(self) -> int:
        return sum(any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))) for w in self.words)

    @cached_property
    def n_top_pair(self) -> int:
        """How often the most frequent pair of neighbouring words occurs."""
        return max(Counter(zip(self.words, self.words[1:])).values(), default=0)

    @cached_property
    def n_bullets(self) -> int:
        return sum(BULLET.match(x) is not None for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(ELLIPSIS.search(x) is not None for x in self.lines)

    def measured(self) -> Doc:
        """This text with the measures of the result taken."""
        for name in ("words", *MEASURES, "base_failed"):
            getattr(self, name)
        return self


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Callable[[Doc], bool]


MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The production rules; ratios are guarded against texts without words or letters.
RULES = (
    Rule("mean_word_length", lambda d: 2 * len(d.words) <= d.word_chars <= 20 * len(d.words)),
    Rule("symbols", lambda d: d.n_symbols <= 0.5 * len(d.words)),
    Rule("duplicate_lines", lambda d: d.n_dup_lines <= 0.5 * len(d.lines)),
    Rule("letters", lambda d: d.letters >= 0.5 * d.word_chars),
    Rule("upper_case", lambda d: d.upper <= 0.7 * d.letters),
    Rule("distinct_words", lambda d: d.n_distinct >= 0.02 * len(d.words)),
    Rule("letter_words", lambda d: d.n_letter_words >= 0.5 * len(d.words)),
    Rule("top_pair", lambda d: d.n_top_pair <= 0.2 * len(d.words)),
    Rule("bullets", lambda d: d.n_bullets <= 0.9 * len(d.lines)),
    Rule("ellipses", lambda d: d.n_ellipses <= 0.5 * len(d.lines)),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, mean cost in ns, share rejected) in cascade order.

    Each row is drawn on its own, about ``sample_rows`` in all whatever they hold.  Texts that the base rule
    rejects are left out, as they never reach the cascade; an empty sample keeps the given order.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    sample = docs.select(F.col(text_col).alias("text")).sample(share, seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, cost, rejected = [], [], []
            for text in b.column(0).to_pylist():
                known = vars(Doc(text).measured())
                for k, rule in enumerate(rules if not known["base_failed"] else ()):
                    doc = Doc(text)
                    vars(doc).update(known)
                    began = time.perf_counter_ns()
                    ok = rule.passes(doc)
                    cost.append(time.perf_counter_ns() - began)
                    which.append(k)
                    rejected.append(0 if ok else 1)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(cost, pa.int64()), pa.array(rejected, pa.int32())], names=["rule", "ns", "rejected"])

    found = {r["rule"]: (r["ns"], r["rejected"]) for r in map_batches(sample, run, "rule int, ns bigint, rejected int").groupBy("rule").agg(F.avg("ns").alias("ns"), F.avg("rejected").alias("rejected")).collect()}
    known = [(rule, *found.get(k, (1.0, 0.0))) for k, rule in enumerate(rules)]
    return sorted(known, key=lambda x: -x[2] / max(x[1], 1.0))


def assess(docs: DataFrame, cascade: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null and empty texts have no words: all measures 0, base_failed true, kept false.  Repeated rows and
    null ids are assessed like others; work grows with a text's length, and a text is held one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(map(Doc, b.column(1).to_pylist()))
            kept = [not d.base_failed and all(r.passes(d) for r in cascade) for d in found]
            out = [b.column(0), pa.array([len(d.words) for d in found], pa.int64()), *(pa.array([getattr(d, m) for d in found], pa.int64()) for m in MEASURES), pa.array([d.base_failed for d in found], pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", *MEASURES, "base_failed", "kept"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"doc_id {kind}, n_words bigint, {', '.join(f'{m} bigint' for m in MEASURES)}, base_failed boolean, kept boolean")


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Order ``rules`` on a sample of ``docs`` and assess every row."""
    return assess(docs, [r for r, _, _ in order_rules(docs, rules)])
