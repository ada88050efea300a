"""SentencePiece encoding and decoding through one table of distinct whitespace-marked chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.blocks import Shelf, by_shard, narrow, pack, unpack
from lumenforge.llm.common import ship_package

MARK = "▁"
#: Chunks of a block, and of the corpus for each owner of a part of the table; what a task holds follows from them.
BLOCK_CHUNKS, SHARD_CHUNKS, ZSTD = 3 << 20, 1 << 22, 4


class PieceModel:
    """A sentencepiece model and whether its texts can be encoded chunk by chunk.

    A chunk is a run of white space markers with the text up to the next marker. If no
    piece has a marker behind another character, no merge crosses a chunk's start, so the
    ids of a text are those of its chunks in order. That also takes a model that does not normalise texts.
    """

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.by_chunk = apart and self.sp.normalize(" a  b\u00a0\ufb01 ") == f"{MARK}{MARK}a{MARK}{MARK}b\u00a0\ufb01{MARK}"
        self.eos = self.sp.eos_id()
        self.anchor = self.sp.piece_to_id("a")

    def whole(self, text: str) -> list[int]:
        return [*self.sp.encode(text, num_threads=1), self.eos]

    def segment(self, chunk: str) -> tuple[list[int], bool]:
        """A chunk's ids, and whether they decode to it behind another piece."""
        # a marker alone at a text's end; the library adds a marker to nothing but an empty text
        ids = self.sp.encode(chunk[1:], num_threads=1) if chunk != " " else [self.sp.piece_to_id(MARK)]
        return ids, self.sp.decode([self.anchor, *ids])[1:] == chunk


def chunks_of(text: str) -> list[str]:
    """A text's chunks, a space for each marker; joined they are a space and the text."""
    if not text:
        return []
    marked = " " + text.replace(MARK, " ")
    if "  " in marked or marked[-1] == " ":
        return re.findall(r" +[^ ]*", marked)
    return [" " + p for p in marked[1:].split(" ")]


class _Places(dict):
    """Chunks numbered as they are met."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _joined(strings: list[str]) -> tuple[bytes, np.ndarray]:
    """Strings as one byte string and their lengths."""
    raw = [s.encode("utf-8", "surrogatepass") for s in strings]
    return b"".join(raw), np.fromiter(map(len, raw), np.uint32, len(raw))


def _parted(body: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _chunked(block_chunks: int):
    """Blocks of documents: ids, chunks of each, the distinct chunks with their keys, and places among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        ids, streams, table, size, seq = [], [], _Places(), 0, 0

        def flush():
            words = list(table)
            at = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")  # frequent chunks get small places
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            text, lengths = _joined([words[i] for i in order])
            body = pack(np.array([len(s) for s in streams], np.uint32), text, narrow(lengths), narrow(place[at]), level=ZSTD)
            return pd.DataFrame({"block": [(part << 32) + seq], "n_chunks": [size], "ids": [ids], "body": [body]})

        for b in batches:
            for i, x in zip(b["id"], b["x"], strict=True):
                chunks = chunks_of(x or "")
                ids.append(i)
                streams.append(np.fromiter(map(table.__getitem__, chunks), np.uint32, len(chunks)))
                size += len(chunks)
                if size >= block_chunks:
                    yield flush()
                    ids, streams, table, size, seq = [], [], _Places(), 0, seq + 1
        if ids:
            yield flush()

    return run


def _keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _asked(shards: int):
    """Each block's distinct chunks, sent to the owners of their parts of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, body in zip(b["block"], b["body"], strict=True):
                _, text, lengths, _ = unpack(body)
                words = _parted(text, lengths)
                out = [(s, block, pack(b"".join([words[i] for i in p.tolist()]), lengths[p], level=ZSTD)) for s, p in by_shard(_keys(words), shards)]
                yield pd.DataFrame(out, columns=["shard", "block", "body"])

    return run


def _segmented(path: str):
    """A part of the table: its distinct chunks, each segmented once, given to every block in the order asked."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model = PieceModel(path)
        table: dict[bytes, tuple[bytes, int, bool]] = {}
        out = []
        for block, body in zip(rows["block"], rows["body"], strict=True):
            asked = _parted(*unpack(body))
            for w in asked:
                if w not in table:
                    own, back = model.segment(w.decode("utf-8", "surrogatepass"))
                    table[w] = np.array(own, np.uint32).tobytes(), len(own), back
            ids, counts, back = zip(*map(table.__getitem__, asked), strict=True)
            out.append((int(block), int(key[0]), pack(narrow(np.frombuffer(b"".join(ids), np.uint32)), narrow(np.array(counts, np.uint32)), np.flatnonzero(~np.array(back)), level=ZSTD)))
        return pd.DataFrame(out, columns=["block", "shard", "body"])

    return run


def _texts(path: str, shards: int, eos: int, blocks: pd.DataFrame, answers: pd.DataFrame) -> Iterator[tuple[object, str, int, str]]:
    """(id, ids as decimals, number of ids, decoded text) of a block's documents; the chunks' ids are joined back by position."""
    model = None
    sizes, text, lengths, at = unpack(blocks["body"].iloc[0])
    raw = _parted(text, lengths)
    words = [w.decode("utf-8", "surrogatepass") for w in raw]
    ids = [""] * len(words)
    count = np.zeros(len(words), np.int64)
    told = dict(zip(answers["shard"].tolist(), answers["body"], strict=True))
    same = np.ones(len(words), bool)
    for s, p in by_shard(_keys(raw), shards):
        own, n, changed = unpack(told[s])
        count[p] = n
        told_ids, ends = list(map(str, own.tolist())), np.cumsum(n, dtype=np.int64).tolist()
        for i, a, z in zip(p.tolist(), [0, *ends[:-1]], ends, strict=True):
            ids[i] = " ".join(told_ids[a:z])
        same[p[changed]] = False
    end = 0
    for doc, n in zip(blocks["ids"].iloc[0], sizes.tolist(), strict=True):
        begin, end = end, end + n
        mine = at[begin:end]
        places = mine.tolist()
        total = count[mine]
        plain = bool(same[mine].all())
        if n and not plain or not total.all():
            model = model or PieceModel(path)
        if not total.all():  # a chunk without ids: leave the text to the library
            got = model.whole("".join([words[i] for i in places])[1:])
            yield doc, " ".join(map(str, got)), len(got), model.sp.decode(got)
            continue
        line = " ".join([*[ids[i] for i in places], str(eos)])
        decoded = "".join([words[i] for i in places])[1:] if plain else model.sp.decode([*map(int, line.split(" "))])
        yield doc, line, int(total.sum()) + 1, decoded


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, block_chunks: int, shard_chunks: int):
    """Blocks and the answers to them, both grouped by block; the number of owners; the type of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = Shelf(docs.sparkSession, "piece-blocks").add(rows.mapInPandas(_chunked(block_chunks), f"block long, n_chunks long, ids array<{kind}>, body binary"))
    size = blocks.agg(F.sum("n_chunks")).first()[0] or 0
    shards = max(6, -(-size // shard_chunks))
    asks = blocks.select("block", "body").mapInPandas(_asked(shards), "shard long, block long, body binary")
    answers = Shelf(docs.sparkSession, "piece-table").add(asks.groupBy("shard").applyInPandas(_segmented(model_path), "block long, shard long, body binary"), moved=True)
    return blocks.select("block", "ids", "body").groupBy("block"), answers.groupBy("block"), shards, kind


def _by_chunk(docs: DataFrame, model_path: str, id_col: str, text_col: str, fields: str, row, block_chunks: int, shard_chunks: int) -> DataFrame:
    """``row(ids, n, decoded)`` of every document."""
    ship_package(docs.sparkSession)
    model = PieceModel(model_path)
    eos = model.eos
    names = [f.split()[0] for f in fields.split(", ")]
    if not model.by_chunk:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = PieceModel(model_path)
            for b in batches:
                told = [m.whole(x or "") for x in b["x"]]
                out = [row(" ".join(map(str, t)), len(t), m.sp.decode(t)) for t in told]
                yield pd.DataFrame({"id": b["id"].to_numpy(), **{k: [o[j] for o in out] for j, k in enumerate(names)}})

        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
        return rows.mapInPandas(whole, f"id {rows.schema['id'].dataType.simpleString()}, {fields}").withColumnRenamed("id", id_col)

    blocks, answers, shards, kind = _encoded(docs, model_path, id_col, text_col, block_chunks, shard_chunks)

    def run(key: tuple, b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        ids, out = [], []
        if len(b):
            for doc, line, n, decoded in _texts(model_path, shards, eos, b, a):
                ids.append(doc)
                out.append(row(line, n, decoded))
        return pd.DataFrame({"id": ids, **{k: [o[j] for o in out] for j, k in enumerate(names)}})

    return blocks.cogroup(answers).applyInPandas(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_chunks: int = BLOCK_CHUNKS, shard_chunks: int = SHARD_CHUNKS) -> DataFrame:
    """id and ``ids``, the int array of each whole text with an end id. Null text counts as empty; see ``piece_digests``."""
    return _by_chunk(docs, model_path, id_col, text_col, "ids array<int>", lambda ids, n, back: ([*map(int, ids.split(" "))],), block_chunks, shard_chunks)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text``: the library's decoding of each ``ids`` array; null ids decode to empty text."""

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [sp.decode([int(i) for i in x]) if x is not None else "" for x in b["ids"]]})

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_chunks: int = BLOCK_CHUNKS, shard_chunks: int = SHARD_CHUNKS) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every whole text, with an end id.

    Blocks of documents send their distinct chunks to the owners of a table, a hash range each; an owner segments every distinct
    chunk once, and a block joins the ids back by position. A chunk that is everywhere is one entry for each block. Where a model's pieces
    cross markers, or it normalises texts, whole texts are encoded instead.

    Null text counts as empty: one id, the end. Repeated ids and rows are each returned; a chunk as
    long as a whole text is segmented whole. Empty input gives no rows; other columns are ignored.
    """

    def row(ids: str, n: int, decoded: str) -> tuple:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return _by_chunk(docs, model_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, block_chunks, shard_chunks)
