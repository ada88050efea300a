"""Licence scan: matching statistics against a generalised suffix automaton of notices, chained into covered spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenforge.llm.common import ship_package, with_text_columns
from lumenforge.llm.license_texts import PHRASES, TEMPLATES

#: Matches of fewer words than this are no part of a chain.
LEAST_MATCH = 3
#: Words of a text that may stand between two matches of a chain.
GAP = 20
#: The share of a template's words that a chain must cover to name its label.
COVERED = 0.8
#: The score of a base phrase where no chain covers more.
PHRASE_SCORE = 0.5

SPAN = "struct<label: string, start: bigint, length: bigint, template: int, covered: bigint, share: double>"

#: Bytes by the byte they count as: capitals as small letters, and all ASCII but letters and digits as space. Other bytes are of letters beyond ASCII.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """All factors of the templates and phrases. A state's factors end at the same places; ``link`` leads to its longest shorter suffix elsewhere."""

    numbers: dict[bytes, int]
    pairs: np.ndarray
    labels: list[str]
    sizes: list[int]
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    #: For each state by template, the numbers of the words at which the state's factors end, ascending.
    ends: list[dict[int, list[int]]] = field(default_factory=list)
    #: For each state, the phrases that end its factors: (label, words).
    phrases: list[list[tuple[str, int]]] = field(default_factory=list)

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, of factors of p's length and one more at most."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    @classmethod
    def build(cls, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> Automaton:
        texts = [words_of(t) for _, t in templates]
        said = [words_of(t) for _, t in phrases]
        numbers: dict[bytes, int] = {}
        for w in (w for t in [*texts, *said] for w in t):
            numbers.setdefault(w, len(numbers) + 1)
        pairs = np.zeros((len(numbers) + 1,) * 2, bool)
        a = cls(numbers, pairs, [label for label, _ in templates], [len(t) for t in texts])
        for t in [*texts, *said]:
            last = 0
            for before, w in zip([None, *t], t, strict=False):
                last = a.extend(last, numbers[w])
                if before is not None:
                    pairs[numbers[before], numbers[w]] = True
        a.ends = [{} for _ in a.next]
        for k, t in enumerate(texts):
            at = 0
            for i, w in enumerate(t):
                at = s = a.next[at][numbers[w]]
                while s > 0:
                    a.ends[s].setdefault(k, []).append(i)
                    s = a.link[s]
        own: dict[int, list[tuple[str, int]]] = {}
        for (label, _), t in zip(phrases, said, strict=True):
            if len(t) < 2:
                raise ValueError("a phrase has two words at least")
            s = 0
            for w in t:
                s = a.next[s][numbers[w]]
            own.setdefault(s, []).append((label, len(t)))
        a.phrases = [[] for _ in a.next]
        for s in sorted(range(1, len(a.next)), key=a.size.__getitem__):  # links lead to shorter ones, which are ready
            a.phrases[s] = own.get(s, []) + a.phrases[a.link[s]]
        return a

    def statistics(self, numbers: list[int], begin: int) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest factor that ends at each word; ``begin`` is the first word's place."""
        state = length = 0
        for i, c in enumerate(numbers, begin):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            state = self.next[state].get(c, 0)
            length = length + 1 if state else 0
            yield i, state, length


def _chains(a: Automaton, matches: list[tuple[int, int, int]]) -> list[tuple]:
    """(label, start, length, template, covered, share) of the chains that cover enough of their template.

    A chain takes matches in the text's order, each at the first place in the template behind the last one; a match that
    overlaps the one before counts with its new words.
    """
    live: dict[int, list[int]] = {}  # template: first word, last word, last word in the template, words covered
    out = []

    def close(k: int) -> None:
        start, end, _, covered = live.pop(k)
        if covered >= COVERED * a.sizes[k]:
            out.append((a.labels[k], start, end - start + 1, k, covered, covered / a.sizes[k]))

    for end, state, length in matches:
        for k, places in a.ends[state].items():
            if k in live:
                first, last, at, covered = live[k]
                behind = bisect_right(places, at)
                if end - length - last <= GAP and behind < len(places):
                    new = min(length, end - last, places[behind] - at)
                    live[k] = [first, end, places[behind], covered + new]
                    continue
                close(k)
            live[k] = [end - length + 1, end, places[0], length]
    for k in sorted(live):
        close(k)
    return out


def _best_spans(spans: list[tuple], n: int) -> list[tuple]:
    """Of spans that share half of their words, the one that covers most."""
    taken = np.zeros(n, bool)
    out = []
    for s in sorted(spans, key=lambda s: (-s[4], -s[5], s[1], s[0], s[3])):
        own = taken[s[1] : s[1] + s[2]]
        if 2 * own.sum() < s[2]:
            own[:] = True
            out.append(s)
    return sorted(out, key=lambda s: (s[1], s[3]))


def scan_words(a: Automaton, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple]]:
    """(label, start) of every phrase, and the covered spans."""
    n = len(words)
    ids = np.fromiter((a.numbers.get(w, 0) for w in words), np.int64, n)
    # a factor of two words and more lies within a stretch whose neighbours all occur as neighbours in a template
    known = np.flatnonzero(a.pairs[ids[:-1], ids[1:]]) if n > 1 else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(known) > 1)
    places, matches = [], []
    for begin, end in zip(known[np.r_[0, cuts + 1]].tolist() if len(known) else [], known[np.r_[cuts, -1]].tolist() if len(known) else [], strict=True):
        before = None
        for i, state, length in a.statistics(ids[begin : end + 2].tolist(), begin):
            places += [(label, i - size + 1) for label, size in a.phrases[state] if size <= length]
            if before and length <= before[2] and before[2] >= LEAST_MATCH:
                matches.append(before)
            before = (i, state, length)
        if before[2] >= LEAST_MATCH:
            matches.append(before)
    return places, _best_spans(_chains(a, matches), n)


def _scanned(a: Automaton, batches: Iterator[list[str | None]]) -> Iterator[list]:
    for texts in batches:
        sizes, places, spans, scores = [], [], [], []
        for text in texts:
            words = words_of(text)
            found, covered = scan_words(a, words)
            sizes.append(len(words))
            places.append([{"label": label, "start": start} for label, start in found])
            spans.append([dict(zip(("label", "start", "length", "template", "covered", "share"), s, strict=True)) for s in covered])
            scores.append(max([PHRASE_SCORE] * bool(found) + [s[5] for s in covered], default=0.0))
        place = pa.struct([("label", pa.string()), ("start", pa.int64())])
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("template", pa.int32()), ("covered", pa.int64()), ("share", pa.float64())])
        yield [pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span)), pa.array(scores, pa.float64())]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, text_col: str = "text") -> DataFrame:
    """``docs`` (columns as _0, _1, ... in their order) with n_words, places (label, start), spans (label, start, length, template, covered, share) and score.

    Words are letters beyond ASCII, letters and digits, A-Z lower-cased, numbered from 0. ``templates`` and ``phrases`` are (label, text) and
    should be few: their suffix automaton goes to every task. Each text streams through it once; a phrase's places are where it ends the
    longest factor, and the longest factors that cannot be extended are chained where a template has them in the same order. A chain that
    covers COVERED of its template is a span; of spans that share half their words the one that covers most stays. ``score`` is the largest share
    of a template that a span covers, PHRASE_SCORE at least where a phrase stands, and 0 without either.

    Rows are worked on where they lie: nothing is shuffled. Null and empty texts have no words, places or spans and score 0; repeated rows are each
    answered; further columns pass through; empty input gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Automaton.build(templates, phrases))
    fields = f"n_words bigint, places array<struct<label: string, start: bigint>>, spans array<{SPAN}>, score double"
    return with_text_columns(docs, text_col, fields, lambda texts: _scanned(shared.value, texts))
