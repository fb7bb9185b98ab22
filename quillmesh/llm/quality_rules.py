"""Quality rules as a short-circuit cascade, ordered by rejections per cost as estimated on a sample.

A document is kept when no rule rejects it, so the order changes the cost and never the result.
"""

from __future__ import annotations

import copy
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))


class Page:
    """Features of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")

    def _count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        inside = self.raw.translate(None, _SPACE)
        return len(inside.decode("utf-8", "surrogatepass"))

    @cached_property
    def n_symbols(self) -> int:
        return self._count(_SYMBOLS)

    @cached_property
    def upper(self) -> int:
        return self._count(_UPPER)

    @cached_property
    def lower(self) -> int:
        return self._count(_LOWER)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.raw.split(b"\n") if line.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window that the text has twice or more."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        found = Counter(windows)
        if len(found) == len(windows):
            return 0
        total = past = 0
        for at, window in enumerate(windows):
            if found[window] > 1:
                total += at + 3 - max(past, at)
                past = at + 3
        return total


#: Rules by name; each tells whether it rejects a page. Whole-number arithmetic, so SQL gives the same.
BASE_RULES: dict[str, Callable[[Page], bool]] = {
    "too_short": lambda p: p.n_words < 50,
    "repeated_windows": lambda p: 100 * p.n_repeat_words > 50 * p.n_words,
}
MORE_RULES: dict[str, Callable[[Page], bool]] = {
    "symbols": lambda p: 100 * p.n_symbols > 30 * p.n_words,
    "shouting": lambda p: p.upper > p.lower,
    "repeated_lines": lambda p: 2 * p.n_dup_lines > len(p.lines),
    "word_length": lambda p: p.word_chars > 15 * p.n_words or p.word_chars < 2 * p.n_words,
}
RULES = BASE_RULES | MORE_RULES


def cascade_order(
    docs: DataFrame, rules: dict[str, Callable[[Page], bool]] | None = None, *, text_col: str = "text", known: list[str] | None = None, after: dict[str, Callable[[Page], bool]] | None = None,
    fraction: float = 0.02, most_rows: int = 64, seed: int = 7,
) -> list[str]:
    """Rule names by rejections per second, best first, as measured on a sample of all partitions.

    Rules are timed where the rows are: ``fraction`` of a partition's rows, ``most_rows`` at most, and only seconds and
    counts leave it. ``known`` features are there before a rule is timed, and pages that a rule of ``after`` rejects are
    left out, as they would be in the run that is ordered; every other feature is at the cost of the rule that needs it.
    Rules without a measurement (an empty sample) keep their place; ties go by name.
    """
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: list[Page] = []
        for batch in batches:
            for text in batch.column(0)[: max(0, most_rows - len(pages))]:
                page = Page(text.as_py())
                for name in known or []:
                    getattr(page, name)
                if rejected_by(page, list(after or {}), after or {}) is None:
                    pages.append(page)
        spent, rejected = [], []
        for rule in rules.values():
            fresh = [copy.copy(page) for page in pages]  # with what is known, and nothing of other rules
            began = time.perf_counter()
            rejected.append(sum(bool(rule(page)) for page in fresh))
            spent.append(time.perf_counter() - began)
        if pages:
            yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(spent), pa.array(rejected, pa.int64())], ["rule", "seconds", "rejected"])

    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(fraction, seed)
    measured = sample.mapInArrow(run, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    worth = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in measured}
    return sorted(rules, key=lambda name: (-worth.get(name, 0.0), name)) if worth else list(rules)


def rejected_by(page: Page, order: list[str], rules: dict[str, Callable[[Page], bool]]) -> str | None:
    """The first rule of the cascade that rejects the page; rules after it aren't run."""
    return next((name for name in order if rules[name](page)), None)


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``doc_id``, the base figures, ``base_failed`` and ``kept`` for each row; no row is dropped.

    The base figures are part of the result and are computed for all rows; the other rules run as a cascade on pages
    that the base rules leave. A null or empty text has no words and is rejected. Null ids stay null, repeated rows are
    judged each, other columns are left out. Narrow: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    order = order or cascade_order(docs, MORE_RULES, text_col=text_col, known=_STATS, after=BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats: dict[str, list[int]] = {n: [] for n in _STATS}
            failed, kept = [], []
            for text in batch.column(1):
                page = Page(text.as_py())
                for name, column in stats.items():
                    column.append(getattr(page, name))
                failed.append(any(rule(page) for rule in BASE_RULES.values()))
                kept.append(not failed[-1] and rejected_by(page, order, MORE_RULES) is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in stats.values()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *stats, "base_failed", "kept"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in _STATS)}, base_failed boolean, kept boolean")


def filtered(docs: DataFrame, *, text_col: str = "text", rules: dict[str, Callable[[Page], bool]] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; each row stops at its first rejection.

    A null or empty text has no words and goes. Null ids and rows that repeat are judged like others, an empty table
    gives an empty table, and no column is added, so none can clash. Narrow: nothing is shuffled.
    """
    rules = RULES if rules is None else rules
    order = order or cascade_order(docs, rules, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [rejected_by(Page(t.as_py()), order, rules) is None for t in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The same figures and verdicts in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
t AS (SELECT rid, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT d.rid, doc_id,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
  length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR upper > lower OR 2 * n_dup_lines > n_lines
    OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM f
"""
