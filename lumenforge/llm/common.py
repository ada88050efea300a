"""Tables, shared scratch folders and small helpers for the training-data operators."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Serve this package to the executors once per application (as ``--py-files`` would)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # whole texts: a batch must stay small
    sc = spark.sparkContext
    if getattr(sc, "_lumenforge_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="lumenforge-")
    path = os.path.join(os.path.realpath(folder), "lumenforge_pkg.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._lumenforge_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenforge-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lumenforge/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _WRITTEN.append(path)
    return out


#: Paths of the tables that this process has written and not discarded.
_WRITTEN: list[str] = []


def written() -> set[str]:
    """The scratch tables there are; what a call adds to them is its own to ``discard_paths``."""
    return set(_WRITTEN)


def discard_paths(spark: SparkSession, paths: set[str]) -> None:
    """Delete scratch tables; no DataFrame over them must be read afterwards."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths & set(_WRITTEN):
        p = hadoop.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN.remove(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``; it must not be read afterwards."""
    discard_paths(df.sparkSession, {getattr(df, "_scratch", "")})


def with_text_columns(docs: DataFrame, text_col: str, fields: str, run, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns ``fields``, computed from whole texts; the columns ``keep``, else all, pass through as _0, _1, ...

    ``run`` gets an iterator over lists of texts (nulls included) and yields, for each, the arrays of the new columns.
    """
    names = re.findall(r"(?:^|, )(\w+) ", fields)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    yield b.column("_text").to_pylist()

        for new in run(texts()):
            b = held.pop()
            kept = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(x if isinstance(x, pa.Array) else pa.array(x) for x in new)], [*kept, *names])

    keep = docs.columns if keep is None else keep
    own = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), fields])
    return own.mapInArrow(columns, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; other text is translated."""
    pure = F.octet_length(c) == F.char_length(c)
    return F.when(pure, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def held_out_column(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id written as text leaves ``remainder``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


class RollingCache(dict):
    """A two-generation cache of a pure function, of at most ``2 * limit`` entries.

    ``cache[key]`` computes missing keys. When the young generation is full it
    becomes the old one; keys in use move back on their next look-up, so frequent keys stay.
    """

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        old = self.old
        value = old[key] if key in old else self.fn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
