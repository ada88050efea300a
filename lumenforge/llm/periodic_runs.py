"""Periodic runs of words: Lyndon roots from suffix ranks, extended by LCP and range minima."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenforge.llm.common import ship_package, with_text_columns

#: A run has at least this many words, and at least two periods.
SHORTEST = 12
#: Such a run repeats at least this many words a period further on: 12 - q for periods up to 6, q for longer ones.
REPEATED = SHORTEST // 2
#: Words of the texts worked on together; a longer text is worked on alone.
BATCH_WORDS = 200_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_ranks(keys: np.ndarray) -> np.ndarray:
    """The place of every suffix among all, by prefix doubling; only suffixes that still share a rank are sorted again.

    ``keys`` order single letters. Letters of different texts differ, and every text ends with a letter that it has nowhere else, so that
    two suffixes with equal prefixes both go on.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    sizes = np.diff(np.r_[heads, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    active, step = order[np.repeat(sizes, sizes) > 1], 1
    while len(active):
        mine = rank[active]
        both = mine * n + rank[active + step]
        order = np.argsort(both, kind="stable")
        active, mine, both = active[order], mine[order], both[order]
        at = np.arange(len(active))
        parted = np.r_[True, np.diff(both) != 0]
        group = np.maximum.accumulate(np.where(np.r_[True, np.diff(mine) != 0], at, 0))
        heads = np.flatnonzero(parted)
        sizes = np.diff(np.r_[heads, len(active)])
        rank[active] = mine + np.repeat(heads, sizes) - group
        active, step = active[np.repeat(sizes, sizes) > 1], 2 * step
    return rank


def common_prefixes(letters: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By rank, how many letters a suffix shares with the one ranked before it; none where that belongs to another text. 0 ends a text."""
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    before = np.where(rank > 0, order[rank - 1], 0).tolist()
    x, shared, h = letters.tolist(), [0] * len(rank), 0
    for i, (c, j) in enumerate(zip(x, before, strict=True)):
        if not c:
            h = 0
            continue
        while x[i + h] == x[j + h]:
            h += 1
        shared[i] = h
        if h:
            h -= 1
    out = np.empty(len(rank), np.int64)
    out[rank] = shared
    return out


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high] of every query: a sparse table whose levels are built one after another, so that one is held at a time."""
    out = np.zeros(len(low), np.int64)
    level = np.frexp(high - low + 1)[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank: where the longest Lyndon word that begins at a place ends."""
    x, n = rank.tolist(), len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, x[i]
        while j < n and x[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


class Extensions:
    """How far two places of one text agree, to the right."""

    def __init__(self, letters: np.ndarray, rank: np.ndarray):
        self.rank, self.shared = rank, common_prefixes(letters, rank)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return range_minima(self.shared, np.minimum(a, b) + 1, np.maximum(a, b))


def find_runs(texts: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """(start, length, period) of all runs of every text, by start and period. Texts are numbers from 1."""
    sizes = np.array([len(x) for x in texts], np.int64)
    stops = np.cumsum(sizes + 1) - 1
    letters = np.concatenate([y for x in texts for y in (x, [0])]).astype(np.int64) if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    begin, stop = (stops - sizes)[owner], stops[owner]
    at, top = np.arange(len(letters)), int(letters.max(initial=0)) + 1
    rank = suffix_ranks(owner * top + letters)
    roots, padded = [], np.r_[np.zeros(3, np.int64), letters, np.zeros(4, np.int64)]
    least = -(-shortest // 4)  # of the repeated words at least half lie on one side of the root's first word
    for places in (rank, suffix_ranks(owner * top + np.where(letters > 0, top - letters, 0))):
        period = next_smaller(places) - at
        further = np.minimum(at + period, stop)
        same = [np.logical_and.reduce([padded[at + 3 + d] == padded[further + 3 + d] for d in side]) for side in (range(min(least, 3)), range(-min(least, 3), 0))]
        own = np.flatnonzero((letters > 0) & (same[0] | same[1]))
        roots.append(np.stack([own, period[own]]))
    i, p = np.unique(np.concatenate(roots, axis=1), axis=1)
    found = np.zeros((4, 0), np.int64)
    if len(i):
        # the same texts read backwards: place x of a text from b to e stands at b + e - 1 - x
        mirror = np.where(at < stop, begin + stop - 1 - at, at)
        backwards = letters[mirror]
        right = Extensions(letters, rank)(i, i + p)
        inner = np.flatnonzero(i > begin[i])
        left = np.zeros(len(i), np.int64)
        left[inner] = Extensions(backwards, suffix_ranks(owner * top + backwards))(mirror[i[inner] - 1], mirror[i[inner] + p[inner] - 1])
        length = p + left + right
        good = length >= np.maximum(shortest, 2 * p)
        start = i - left
        found = np.unique(np.stack([owner[i], start - begin[i], p, length])[:, good], axis=1)
    edges = np.searchsorted(found[0], np.arange(len(texts) + 1))
    return [found[1:][:, a:b].T[:, [0, 2, 1]] for a, b in zip(edges, edges[1:], strict=False)]


def _repeats(texts: list[np.ndarray], width: int = REPEATED) -> np.ndarray:
    """Which texts may hold some words twice: all that do, and those whose hashes collide."""
    sizes = np.array([len(x) for x in texts], np.int64)
    x = np.concatenate([*texts, np.zeros(width, np.int64)]).astype(np.uint64)
    n, owner = len(x) - width, np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        h = (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(width):
            h = (h ^ (x[k : k + n] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    inside = np.arange(n) + width <= np.repeat(np.cumsum(sizes), sizes)
    h, owner = h[inside], owner[inside]
    order = np.argsort(h, kind="stable")
    twice = np.flatnonzero(np.diff(h[order].astype(np.int64)) == 0)
    out = np.zeros(len(texts), bool)
    out[owner[order[twice]]] = True
    return out


def _described(batches: Iterator[list[str | None]]) -> Iterator[list]:
    for texts in batches:
        runs: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
        collapsed: list[str] = [""] * len(texts)
        sizes = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[bytes]]] = []
        size = 0

        def work(held, runs=runs, collapsed=collapsed):
            number = defaultdict(count(1).__next__)
            coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for _, words in held]
            again = np.flatnonzero(_repeats(coded))
            found = dict(zip(again.tolist(), find_runs([coded[k] for k in again]), strict=True))
            for k, (row, words) in enumerate(held):
                mine = found.get(k)
                if mine is not None and len(mine):
                    runs[row] = mine
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, mine[:, 0] + mine[:, 2], 1)
                    np.add.at(change, mine[:, 0] + mine[:, 1], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                collapsed[row] = b" ".join(words).decode("utf-8", "surrogatepass")

        for row, text in enumerate(texts):
            words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII's six spaces only
            sizes[row] = len(words)
            if held and size + len(words) > BATCH_WORDS:
                work(held)
                held, size = [], 0
            held.append((row, words))
            size += len(words)
        if held:
            work(held)
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        yield [sizes, pa.ListArray.from_arrays(pa.array(offsets), rows), collapsed]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (columns as _0, _1, ... in their order) with n_words, runs (start, length, period, by start and period) and collapsed.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words with smallest period q (words q apart
    are equal), at least SHORTEST words and two periods long, that no neighbouring word extends. ``collapsed`` joins the words by one
    space, without those that some run holds after its first period.

    By the runs theorem every run has a root that is the longest Lyndon word at its place in one of two opposite orders of the words: the
    words between a place and the next smaller inverse suffix array value. Roots are extended to both sides by range minima of common
    prefixes, of the text and of its reverse. Texts without REPEATED words that come twice hold no run and are passed over before.

    Rows are worked on where they lie: nothing is shuffled. A text is held whole in one task, some 200 bytes a word. Null and empty texts have no
    words, no runs and an empty collapsed text; repeated rows are each answered; further columns pass through; empty input gives no rows.
    """
    ship_package(docs.sparkSession)
    return with_text_columns(docs, text_col, f"n_words bigint, runs {RUNS}, collapsed string", _described)
