"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenforge.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{float(x):.9g}"
    if isinstance(x, (int, np.integer)):
        return f"{float(x):.9g}" if abs(int(x)) < 1 << 50 else str(x)
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_lanes_do_not_overlap(spark):
    got = catalog.QUERIES["w4_lanes"](spark, DATA).toPandas()
    for _, g in got.groupby(["user_id", "day"]):
        g = g.sort_values(["s", "e", "event_id"])
        for _, lane in g.groupby("lane"):
            assert (lane.s.to_numpy()[1:] >= lane.e.to_numpy()[:-1]).all()
        assert (g.lane < g.lane_count).all()


def test_lanes_are_the_first_free_ones(spark):
    """Every item, in order, takes the lowest lane whose last item has ended; a cluster counts the lanes it needs."""
    got = catalog.QUERIES["w4_lanes"](spark, DATA).toPandas()
    for _, g in got.groupby(["user_id", "day"]):
        taken, members, reach = {}, [], None

        def close(members=None):
            assert all(r.lane_count == 1 + max(m.lane for m in members) for r in members)

        for r in g.sort_values(["s", "e", "event_id"]).itertuples():
            if reach is None or r.s >= reach:  # nothing before lasts until here: a new cluster with all lanes free
                if members:
                    close(members)
                taken, members = {}, []
            assert r.lane == next(k for k in range(len(g) + 1) if taken.get(k, r.s) <= r.s)
            taken[r.lane] = r.e
            members.append(r)
            reach = r.e if reach is None else max(reach, r.e)
        close(members)


def test_fold_decomposes_latin_letters(spark):
    from pyspark.sql import functions as F

    from lumenforge.functions import scalar

    row = spark.createDataFrame([("ő ž İ naïve ñandú Ệ e\u0301x",)], "x string").select(scalar.fold(F.col("x"))).first()
    assert row[0] == "o z i naive nandu e ex"


def test_lanes_walk_clusters_in_batches(spark):
    """Clusters longer than an Arrow batch, and many of one item: no group of its own for each."""
    from pyspark.sql import functions as F

    from lumenforge.operators import schedule

    items = spark.range(600).select((F.col("id") % 3).alias("k"), F.when(F.col("id") < 300, F.col("id") % 40 * 5).otherwise(F.col("id") * 10).alias("s"), F.col("id").alias("n"))
    items = items.withColumn("e", F.col("s") + F.when(F.col("n") < 300, 1 + F.col("n") % 17).otherwise(4))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = schedule.lanes(items, ["k"], "s", "e", "n")
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
        got = df.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 600
    for _, g in got.groupby(["k", "cluster"]):
        free = []
        for r in g.sort_values(["s", "e", "n"]).itertuples():
            k = next((i for i, t in enumerate(free) if t <= r.s), len(free))
            free[k : k + 1] = [r.e]
            assert r.lane == k
        assert (g.lane_count == len(free)).all()


def test_captured_sections_of_large_part_numbers(spark, tmp_path):
    """Lines with one number are laid out by the identifier that the payload has, which is the part's number modulo 100,000."""
    day = pd.Timestamp("1997-03-01").to_pydatetime()
    spark.createDataFrame([(1, day), (2, day)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7, 1, 10.0), (1, 100009, 1, 10.0), (2, 7, 1, 10.0)], "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(catalog.QUERIES["s21_captured_sections"](spark, str(tmp_path)).toPandas()) == rows(c.sql(catalog.ORACLE_SQL["s21_captured_sections"]).df())


def test_customers_are_dealt_before_they_become_many_rows(spark):
    """One split of a file holds all customers: what each becomes is not made and deduplicated by one task."""
    assert "RoundRobinPartitioning" in catalog.QUERIES["g16_credited_groups"](spark, DATA)._jdf.queryExecution().toString()


def test_parts_are_dealt_before_they_become_postings(spark, monkeypatch):
    from lumenforge.operators import search_index
    from lumenforge.plans import fielded_plans
    from lumenforge.plans.registry import Tables

    asked = []
    monkeypatch.setattr(search_index, "stored_index", lambda docs, *rest: asked.append(docs))
    fielded_plans._index(Tables(spark, DATA))
    assert "RoundRobinPartitioning" in asked[0]._jdf.queryExecution().toString() and len(asked[0].inputFiles()) == 1
