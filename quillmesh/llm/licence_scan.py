"""Licence scan: matching statistics of every text against a generalised suffix automaton of licence tokens.

The automaton holds every phrase and notice. Streaming a text's words through it gives, at each word, the longest
match that ends there. Maximal matches of several words are chained in the order of a notice, and a notice of which
enough words are covered is a span. A phrase stands at a place when it is a suffix of the match that ends there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.licence_templates import PHRASES, TEMPLATES

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (in lower case) and all non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; ``ends[state]`` has (string, end) of all occurrences."""

    def __init__(self, strings: list[list[int]]):
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, string in enumerate(strings):
            state = 0
            for end, word in enumerate(string):
                state = self._extended(state, word)
                self.ends[state].add((k, end))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, arrows: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arrows)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the match one longer than ``state``'s, split off ``target`` where that is longer still."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        if (known := self.next[last].get(word)) is not None:
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new


class LicenceScanner:
    """Scanner of single texts. ``min_match``: words of a match that counts; ``coverage``: share of a notice that
    makes a span; ``max_gap``: words of a text that may stand between matches of a chain."""

    def __init__(self, phrases=None, templates=None, min_match: int = 4, coverage: float = 0.7, max_gap: int = 30):
        phrases = PHRASES if phrases is None else phrases
        self.templates = [(label, text.encode().split()) for label, text in (TEMPLATES if templates is None else templates)]
        spoken = [(label, text.encode().split()) for text, label in phrases.items()]
        self.ids: dict[bytes, int] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in [*self.templates, *spoken]]
        self.automaton = SuffixAutomaton(coded)
        self.min_match, self.coverage, self.max_gap = min_match, coverage, max_gap
        own = defaultdict(list)
        for (label, words), code in zip(spoken, coded[len(self.templates) :], strict=True):
            state = 0
            for word in code:
                state = self.automaton.next[state][word]
            own[state].append((len(words), label))
        #: Phrases that are suffixes of a state's matches, with their length.
        self.phrases: list[list[tuple[int, str]]] = []
        for state in range(len(self.automaton.link)):
            found, up = [], state
            while up > 0:
                found += own.get(up, [])
                up = self.automaton.link[up]
            self.phrases.append(found)

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        known = self.ids.get
        arrows, lengths, links, phrases = self.automaton.next, self.automaton.length, self.automaton.link, self.phrases
        state = size = 0
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        for at, word in enumerate(map(known, words)):
            if word is None:
                if size >= self.min_match:
                    matches.append((at - size, size, state))
                state = size = 0
                continue
            onward = arrows[state].get(word)
            if onward is None:
                if size >= self.min_match:
                    matches.append((at - size, size, state))
                while onward is None and state:
                    state = links[state]
                    size = lengths[state]
                    onward = arrows[state].get(word)
            if onward is not None:
                state, size = onward, size + 1
                if phrases[state]:
                    places += [(at - n + 1, label) for n, label in phrases[state] if n <= size]
        if size >= self.min_match:
            matches.append((len(words) - size, size, state))
        spans = self._chained(matches)
        base = {label for _, label in places}
        best = max([1.0] if places else [0.0], default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((p for p, _ in places), default=None),
            "last_word": max((p for p, _ in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s["label"] for s in spans if s["coverage"] >= self.coverage})),
            "score": max([best, *(s["coverage"] for s in spans)]),
            "spans": [s for s in spans if s["coverage"] >= self.coverage],
        }

    def _chained(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """For each notice the chain that covers most of it. Per notice, one chain is kept for each place of the
        notice where a chain may end, so the work for a match is bounded by the notice's length."""
        chains: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)  # end in the notice: covered, first, past
        best: dict[int, tuple[int, int, int]] = {}
        for start, size, state in matches:
            for k, end in self.automaton.ends[state]:
                if k >= len(self.templates):
                    continue
                first = end - size + 1
                pick = (size, start, start + size)
                for stop, (covered, began, past) in chains[k].items():
                    # the overlap with the chain, in the text or the notice, counts once
                    over = max(0, past - start, stop + 1 - first)
                    if stop < end and over < size and start - past <= self.max_gap and covered + size - over > pick[0]:
                        pick = (covered + size - over, began, start + size)
                if end not in chains[k] or pick[0] >= chains[k][end][0] or start - chains[k][end][2] > self.max_gap:
                    chains[k][end] = pick
                if pick[0] > best.get(k, (0,))[0]:
                    best[k] = pick
        return [
            {"label": self.templates[k][0], "start": began, "end": past, "coverage": covered / len(self.templates[k][1])}
            for k, (covered, began, past) in sorted(best.items())
        ]


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: the phrase places, labels, score and covered notice spans.

    A null or empty text has no words, labels or spans and scores 0. Null ids stay null, repeated rows are scanned each
    on their own, other columns are left out, an empty table gives an empty table. Narrow: nothing is shuffled.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(**options)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [scanner.scan(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], ["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,coverage:double>>",
    )
