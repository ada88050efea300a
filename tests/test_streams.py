"""Streams over more files than two batches take, newest first, give the rows of the registered SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenforge.plans import catalog
from tests.test_plans import DATA, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", ["t1_opened_stream", "k10_captured_stream"])
def test_late_files_count(spark, tmp_path, name):
    spark.read.parquet(f"{DATA}/events.parquet").repartitionByRange(140, F.desc("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 128  # a watermark drops rows from the third batch on
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())
