"""Blocks of rows that ask owners of a corpus-wide table for the keys they hold.

A block is a row with many documents in packed arrays. It sends each owner (a hash range of
keys, a *shard*) its own distinct keys once, however often they occur, and gets back the owner's
values in the order asked. A message is one row, never larger than the rows it stands for. No task
holds the table, and a key that is everywhere is one entry for each block.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lumenforge.llm.common import scratch_path

_HEAD = struct.Struct("<2sIQ")


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays, split into byte planes, and byte strings, compressed one by one."""
    z = zstandard.ZstdCompressor(level=level)
    out = []
    for a in arrays:
        if isinstance(a, bytes):
            kind, body = b"s1", a
        else:
            kind = a.dtype.str[1:].encode()
            body = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
        small = z.compress(body)
        out += [_HEAD.pack(kind, len(small), len(body)), small]
    return b"".join(out)


def unpack(body: bytes) -> list:
    """What ``pack`` was given."""
    z = zstandard.ZstdDecompressor()
    out, at = [], 0
    while at < len(body):
        kind, small, size = _HEAD.unpack_from(body, at)
        at += _HEAD.size
        raw = z.decompress(body[at : at + small], max_output_size=max(1, size))
        at += small
        if kind == b"s1":
            out.append(raw)
        else:
            dtype = np.dtype(kind.decode())
            planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, size // dtype.itemsize)
            out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """The first value and the differences after it; ``np.cumsum`` gives the values back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def mixed(keys: np.ndarray) -> np.ndarray:
    """64-bit keys, each to one value with well-mixed bits."""
    k = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return k ^ (k >> np.uint64(29))


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def parts(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its entries in their order) for every shard in ``shard``."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[p[0]]), p) for p in np.split(order, cut) if len(p)]


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """``parts`` of the shards that own ``keys``."""
    return parts((mixed(keys) % np.uint64(shards)).astype(np.int64))


class Shelf:
    """A table in the shared folder, bucketed by ``block``; what lies on two shelves meets on ``block`` without moving again."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, scratch_path(spark, label)
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"lumenforge_{uuid.uuid4().hex}"

    def add(self, rows: DataFrame, moved: bool = False) -> DataFrame:
        """Add rows and return all. Blocks are written where they are made; ``moved`` first brings answers to their blocks' buckets."""
        if moved:
            rows = rows.repartition(self.buckets, "block")
        rows.write.mode("append").bucketBy(self.buckets, "block").option("path", self.path).format("parquet").saveAsTable(self.name)
        return self.spark.table(self.name)
