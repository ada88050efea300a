"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenforge.operators.graph import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables: ``t("orders")`` reads one, ``t.stream("events")`` follows it as a stream."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A table's rows on all cores, for work that costs far more than moving a row: millions of rows fit one split of a file."""
        return self(name).repartition(4 * self._spark.sparkContext.defaultParallelism)

    def parts(self, name: str) -> int:
        """Into how many parts to deal what grows with a table, so that a part stays small however large the table: eight for each split of its files."""
        return max(8 * self(name).rdd.getNumPartitions(), int(self._spark.conf.get("spark.sql.shuffle.partitions")))

    def folder(self, name: str) -> str:
        """A folder below ``spark.checkpoint.dir`` for what later queries read again, the same for all queries of an application."""
        return shared_folder(self._spark, name)

    def stream(self, name: str, files_per_batch: int = 64) -> DataFrame:
        reader = self._spark.readStream.schema(self(name).schema).option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(f"{self._dir}/{name}.parque[t]")  # a pattern, as a stream's source is a directory or a glob


def query(sql: str | None = None):
    """Register a function of (spark, tables) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
