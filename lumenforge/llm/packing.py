"""Order-preserving packing of token streams into fixed windows by dynamic programming."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import RollingCache, ship_package

WINDOW = 2048
END_ID = 1
#: What a window's end costs, in tokens of padding: inside a sentence, at a sentence's end; at a document's end nothing.
CUT_ANYWHERE, CUT_SENTENCE = 12, 2
CACHE_LIMIT = 150_000
#: Documents whose windows are chosen together; the window left open at a block's end goes on in the next block.
BLOCK_TOKENS = 1 << 19
#: The pre-tokeniser's pattern of the vocabulary; a fixed value of that tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACES = re.compile(r"\s\s|^\s|\s$")


def added_tokens(json_path: str) -> dict[str, int]:
    """The tokens of a ``tokenizers`` file that are cut out of texts before they are encoded, with their ids."""
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that depend on what is around them are not supported")
    return {t["content"]: t["id"] for t in added}


class ByteEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, from a rank file of the vocabulary.

    Texts without neighbouring white space are cut before each space and line break. No token
    crosses such a cut, so the ids of the distinct pieces are joined; other texts are encoded whole.
    Texts are first split at ``added`` tokens, which get their own ids.
    """

    def __init__(self, ranks_path: str, limit: int = CACHE_LIMIT, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token[-1:] in (b".", b"!", b"?", b"\n")
        self.table = RollingCache(self.whole, limit)
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.split.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if "\x00" in text or _SPACES.search(text):
            return self.whole(text)
        pieces = text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")
        return b"".join(map(self.table.__getitem__, pieces))


def choose_cuts(cuts: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the cheapest windows over a stream whose last possible cut is its end.

    ``cuts`` ascends and steps by at most ``window``; the cost of a window is its padding plus
    the cost of its end. f(j) = cost(j) + window + min over i in [j - window, j) of (f(i) - (j - i)):
    f(i) + i does not depend on j, so a monotone queue gives each minimum in constant time. The
    last window's padding is not counted, as the stream goes on behind it. Ties take the longest window.
    """
    if not len(cuts):
        return []
    at, cost = cuts.tolist(), costs.tolist()
    back = [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # f(i) + i, i, index of i
    last = len(at) - 1
    for k, j in enumerate(at):
        while queue[0][1] < j - window:
            queue.popleft()
        best, _, back[k] = queue[0]
        if k == last:
            break
        key = best + cost[k] + window  # f(j) + j
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j, k))
    # the stream's end: any window start within reach, without the padding behind it
    best = min(queue, key=lambda q: q[0] - q[1])
    back[last] = best[2]
    out, k = [], last
    while k >= 0:
        out.append(at[k])
        k = back[k]
    return out[::-1]


def _pack(ranks_path: str, end_id: int, window: int, added: dict[str, int] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = ByteEncoder(ranks_path, added=added)
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sequence, offset = part << 40, 0  # the open window and how far it is filled
        ids_of, texts, size = [], [], 0

        def flush(final: bool):
            nonlocal sequence, offset
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            stops = np.cumsum(lengths)
            stream = np.frombuffer(b"".join(texts), "<u4")
            total = len(stream)
            # shifted by what the open window holds already
            ends = np.flatnonzero((enc.ends[np.minimum(stream, len(enc.ends) - 1)]) & (stream < len(enc.ends))) + 1 + offset
            doc_ends = stops + offset
            natural = np.union1d(ends, doc_ends)
            # a full window behind each of them, and a grid where sentences are longer than a window
            forced = np.concatenate((natural + window, np.arange(window, total + offset, window // 8)))
            cuts = np.union1d(natural, forced[(forced > offset) & (forced < total + offset)])
            cost = np.full(len(cuts), CUT_ANYWHERE, float)
            cost[np.searchsorted(cuts, ends)] = CUT_SENTENCE
            cost[np.searchsorted(cuts, doc_ends)] = 0
            chosen = choose_cuts(cuts, cost, window)
            rows = []
            doc, start, at = 0, 0, offset  # within the stream: document, its ids used, place
            begin, seq = 0, sequence
            for stop in chosen:
                while at < stop:
                    take = min(stop - at, int(lengths[doc]) - start)
                    piece = texts[doc][4 * start : 4 * (start + take)]
                    rows.append((ids_of[doc], start, take, zlib.crc32(piece), int(lengths[doc]), seq, at - begin))
                    start += take
                    at += take
                    if start == lengths[doc]:
                        doc, start = doc + 1, 0
                if stop != chosen[-1] or stop - begin == window:
                    begin, seq = stop, seq + 1
            sequence, offset = seq, at - begin
            columns = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return pd.DataFrame(rows, columns=columns)

        for b in batches:
            for i, x in zip(b["id"], b["x"], strict=True):
                ids_of.append(i)
                texts.append(enc.encode(x or "") + end)
                size += len(texts[-1]) // 4
                if size >= BLOCK_TOKENS:
                    yield flush(False)
                    ids_of, texts, size = [], [], 0
        if texts:
            yield flush(True)

    return run


def pack_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, added: dict[str, int] | None = None) -> DataFrame:
    """Pack all documents, in the order of the input's partitions, into sequences of at most ``window`` ids.

    Cuts lie at documents' or sentences' ends, a full window behind one of them, or every
    ``window / 8`` ids where there are none, chosen by ``choose_cuts`` to minimise padding plus penalties. Each task
    packs its own stream, so one sequence a task is left open. Returns a row for
    each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are split at ``added`` tokens (``added_tokens``), which get their ids; without them they are encoded as any other text.
    Null and empty texts are the end id alone; repeated ids are packed as documents of
    their own; a text longer than a window gives several pieces. Empty input gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(_pack(ranks_path, end_id, window, added), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
