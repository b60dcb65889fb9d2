"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is a pure predicate on one text. Cost (seconds per document) and
selectivity (share rejected) of each rule are estimated on a bounded sample;
rules then run in falling order of rejections per second and stop at the first
that rejects. The order changes only the time: the verdict is a conjunction.
"""

from __future__ import annotations

import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texweave.llm.common import trim, trimmed

#: Characters that count as symbols, a fixed value of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 512
SAMPLE_CHARS = 20_000


@lru_cache(maxsize=1)
def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    return np.array([k == "Lu" for k in kinds]), np.array([k[0] == "L" for k in kinds])


class TextView:
    """One text and the measures that rules ask for, each computed once.

    Words are runs of bytes other than space and TAB..CR; null is no text.
    """

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # on bytes: exactly 0x20 and 0x09-0x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        ids = self.ids
        keys = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
            keys ^= keys >> np.uint64(29)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if not same.any():
            return 0
        starts = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        # Hashes only nominate: equal windows are counted by their words.
        windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts]
        _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = starts[counts[inverse.ravel()] > 1]
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Upper-case letters and all letters."""
        codes = np.frombuffer(self.raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        upper, letter = _letter_tables()
        return int(upper[codes].sum()), int(letter[codes].sum())

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextView], bool]


#: The production rules. Each has an equal in SQL (see queries.py).
RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("shouting", lambda t: 100 * t.letters[0] > 40 * t.letters[1]),
    Rule("few_letters", lambda t: 2 * t.letters[1] < t.word_chars),
    Rule("top_word", lambda t: 100 * t.top_word > 30 * t.n_words),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """Cost and selectivity of each rule on ``sample_rows`` rows of up to SAMPLE_CHARS characters.

    Only as many partitions are read as hold the sample, which decides the
    order of the rules and never a verdict.
    """
    short = docs.filter(F.length("text") <= SAMPLE_CHARS)
    sample = short.select(F.col("text").cast("binary").alias("raw")).limit(sample_rows).collect()
    rows = [bytes(r["raw"]) for r in sample]
    found = []
    for rule in rules:
        views = [TextView(x) for x in rows]
        for view in views:
            view.words, view.lines  # what rules share is not a rule's cost
        began = time.thread_time()
        hits = sum(bool(rule.rejects(x)) for x in views)
        found.append((rule.name, len(rows), hits, time.thread_time() - began))
    return pd.DataFrame(found, columns=["rule", "n", "hits", "seconds"])


def order(estimates: pd.DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second, highest first; ties and rules without an estimate keep their place."""
    rate = {r.rule: r.hits / max(r.seconds, 1e-9) for r in estimates.itertuples()}
    return tuple(sorted(rules, key=lambda r: -rate.get(r.name, 0.0)))


def first_rejection(view: TextView, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(view)), None)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the base measures and the verdict of every row of ``docs``.

    Null and empty texts have no words, so ``base_failed`` is true and they are
    not kept. Repeated rows are judged each; other columns are ignored. No
    shuffle: one pass over the texts. An empty table gives an empty result.
    """
    ranked = order(estimate(docs, rules), rules)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                t = TextView(raw.as_py())
                rejected = t.base_failed or first_rejection(t, ranked) is not None
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.base_failed, not rejected))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id long, {MEASURES}")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged.

    Here the cascade stops at the first rejection, so costly measures are not
    computed for texts that a cheap rule has rejected.
    """
    ranked = order(estimate(docs, rules), rules)

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([first_rejection(TextView(bytes(x) if x is not None else None), ranked) is None for x in raw], dtype=bool)
        trim()

    return docs.filter(passes(F.col("text").cast("binary")))
