"""Batches of the job queue: new and standing jobs, rising tiers, repeated specs and outcomes, wrong leases, nulls."""

import datetime as dt

from pyspark.sql import functions as F

from lumenforge.operators import queue

NOW = dt.datetime(2024, 1, 1)
JOB = "k string, url string, tier string, next_fetch_at timestamp_ntz"
HELD = "k string, tier string, next_fetch_at timestamp_ntz, last_ok_at timestamp_ntz, failures int, last_error string, lease_token string"


def at(s):
    return NOW + dt.timedelta(seconds=s)


def test_enqueued(spark):
    jobs = spark.createDataFrame([("a", "u", "baseline", at(9000)), ("b", "u", "hot", at(50)), ("c", "u", "hot", at(60)), ("d", "u", "hot", at(70))], JOB)
    specs = spark.createDataFrame([("a", "v", "baseline", False, None), ("a", "w", "hot", False, at(1)), ("b", "v", "baseline", None, at(1)), ("c", "v", "hot", True, None), ("e", "v", None, False, None), ("f", "v", "hot", True, at(7)), (None, "v", "hot", True, None)], "k string, url string, tier string, due_now boolean, next_at timestamp_ntz")
    got = {r.k: (r.url, r.tier, (r.next_fetch_at - NOW).total_seconds(), r.inserted) for r in queue.enqueued(jobs, specs, "k", F.lit(NOW).cast("timestamp_ntz"), F.lit(0.5)).collect()}
    assert got == {"a": ("w", "hot", 120, False), "b": ("v", "baseline", 50, False), "c": ("v", "hot", 0, False), "d": ("u", "hot", 70, None), "e": ("v", None, 3600, True), "f": ("v", "hot", 7, True)}
    assert queue.enqueued(jobs.where("false"), specs.where("false"), "k", F.lit(NOW).cast("timestamp_ntz"), F.lit(0.5)).count() == 0


def test_completed(spark):
    jobs = spark.createDataFrame([(k, t, at(5), None, n, "old", x) for k, t, n, x in (("a", "hot", 3, "x"), ("b", "hot", 2, "x"), ("c", "baseline", 40, "x"), ("d", "hot", 0, None), ("e", "hot", 1, "x"))], HELD)
    told = spark.createDataFrame([("a", True, "x", None, None), ("b", False, "x", "bad", None), ("b", True, "y", None, None), ("c", None, "x", None, None), ("d", True, None, None, None), ("z", True, "x", None, None)], "k string, ok boolean, lease_token string, error string, next_at timestamp_ntz")
    run = lambda **kw: {r.k: ((r.next_fetch_at - NOW).total_seconds(), r.failures, r.last_error, r.lease_token, r.accepted) for r in queue.completed(jobs, told, "k", F.lit(NOW).cast("timestamp_ntz"), F.lit(0.5), **kw).collect()}
    got = run()
    assert got == {"a": (120, 0, None, None, True), "b": (480, 3, "bad", None, True), "c": (86400, 41, "unspecified", None, True), "d": (5, 0, "old", None, False), "e": (5, 1, "old", "x", None)}
    assert run(trusted=True)["d"] == (120, 0, None, None, True)
