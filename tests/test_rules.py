"""Rules, postings, writers and places on small inputs with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import fielded, rules, sections, writers

GROUPS = [(1, 1, "all_of", 0.0), (1, 2, "sequence_choice", 0.0), (1, 3, "points_matching", 6.0), (1, 4, "attested", 0.0), (1, 5, "n_of", 0.0)]


def audit(spark, taken, attested=()):
    people = spark.createDataFrame([("p", 1)], "person string, program long")
    groups = spark.createDataFrame(GROUPS, "program long, grp long, kind string, need double")
    wanted = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 0, "b"), (1, 2, 0, "c"), (1, 2, 0, "d"), (1, 2, 0, "e"), (1, 2, 1, "f"), (1, 2, 1, "g")], "program long, grp long, seq long, course string")
    members = spark.createDataFrame([(1, 3, x) for x in "abcx"], "program long, grp long, course string")
    rows = rules.evaluate(people, spark.createDataFrame(taken, "person string, course string, planned boolean, points double"), groups, wanted, members, spark.createDataFrame(list(attested), "person string, program long, grp long"), "person").collect()
    return {r.grp: (r.completed, r.required, r.status) for r in rows}


def test_rules_of_every_kind(spark):
    got = audit(spark, [("p", "a", False, 4.0), ("p", "a", True, 4.0), ("p", "c", False, None), ("p", "f", True, 3.0), ("p", None, False, 9.0), ("q", "b", False, 1.0)], [("p", 1, 4)])
    assert got == {1: (1.0, 2.0, "in_progress"), 2: (1.0, 2.0, "in_progress"), 3: (6.0, 6.0, "satisfied"), 4: (1.0, 1.0, "satisfied"), 5: (0.0, 0.0, "satisfied")}


def test_rules_of_nothing_taken(spark):
    assert audit(spark, []) == {1: (0.0, 2.0, "unmet"), 2: (0.0, 3.0, "unmet"), 3: (0.0, 6.0, "unmet"), 4: (0.0, 1.0, "unmet"), 5: (0.0, 0.0, "satisfied")}


def test_postings_and_totals_count_empty_documents(spark):
    docs = spark.createDataFrame([(1, "Red red", None), (2, None, "red"), (3, "", None)], "id long, title string, body string")
    post = fielded.fielded_postings(docs, "id", {"title": F.col("title"), "body": F.col("body")})
    assert sorted(map(tuple, post.select("doc", "term", "tf", "mask", "doc_length").collect())) == [(1, "red", 2, 1, 2), (2, "red", 1, 8, 1)]
    assert tuple(fielded.totals(docs, post).first()) == (3, 1.0)
    assert tuple(fielded.totals(docs.limit(0), post.limit(0)).first()) == (0, 0.0)
    assert fielded.scored(post, fielded.totals(docs, post), fielded.parse_query("zebra ")).count() == 0


def test_parsed_codes(spark):
    parsed = fielded.parse_query("CS W4118 and ml", {"cs": ["coms"]}, {"ml": ["machine"]})
    assert parsed.codes == ("cs4118", "csw4118", "coms4118")
    assert [g.prefix for g in parsed.groups][-1] and fielded.parse_query("  ").groups == ()


def test_soft_delete_stamps_once(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None), (None, None)], "k long, at long")
    gone = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert sorted(((r.k, r["at"]) for r in writers.soft_deleted(rows, gone, ["k"], "at", F.lit(9).cast("long")).collect()), key=str) == [(1, 9), (2, 5), (3, None), (None, None)]


def test_places_by_name_and_by_part(spark):
    rows = spark.createDataFrame([(1, "hall"), (2, "old hall"), (3, ""), (4, None), (5, "zoo")], "k long, text string")
    places = spark.createDataFrame([(7, "hall"), (8, "old hall"), (9, None)], "building long, name string")
    assert sorted(map(tuple, sections.contained_match(rows, places, "k").collect())) == [(1, 7), (2, 8)]
    assert sections.contained_match(rows, places.limit(0), "k").count() == 0


@pytest.mark.parametrize(("now", "before", "reason"), [((7, 7), (10, 10), None), ((6, 6), (10, 10), "records"), ((10, 4), (10, 10), "filled"), ((0, 0), (2, 2), "empty"), ((2, 0), (2, 2), "all filled lost"), ((2, 3), (9, 9), "incoherent"), ((None, 0), (9, 9), "incoherent"), ((1, 1), None, None)])
def test_quarantine(spark, now, before, reason):
    shape = "k long, records long, filled long"
    old = spark.createDataFrame([(1, *before)] if before else [], shape)
    assert writers.quarantined(spark.createDataFrame([(1, *now)], shape), old, ["k"]).first().reason == reason


def test_parts_grow_with_the_table(spark):
    """More splits of the files make more parts, so that one task's share does not grow; rows stay the same."""
    from lumenforge.plans.catalog import QUERIES

    names = ("oq2_completed", "oq2_enqueued", "g10_counted_courses")
    want = {n: sorted(map(str, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for name in names:
            got = QUERIES[name](spark, "/root/testdata/sf0.001")
            assert got.rdd.getNumPartitions() > 4
            assert sorted(map(str, got.collect())) == want[name]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
