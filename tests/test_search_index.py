"""A stored index answers like the postings it was made of."""

import random

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import fielded, search, search_index

WORDS = "red reddish rod widget widgets wigdet green of the 12 brand7 part77 x1y2 blue".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), "clash") for i in range(300)]
    return spark.createDataFrame([*rows, (300, None, None, None)], "id long, title string, body string, doc string").repartition(3)


QUERIES = [
    [search.Group([("red", 1.0), ("green", 0.85)]), search.Group([("widg", 1.0)], prefix=True, fuzzy=True)],
    [search.Group([("wigets", 1.0)], fuzzy=True), search.Group([("the", 0.25)])],
    [search.Group([("zzzz", 1.0)], prefix=True, fuzzy=True), search.Group([("blue", 1.0)])],
    [search.Group([("nothing", 1.0)])],
    [],
]


@pytest.mark.parametrize("codes", [(), ("part77",), ("nosuch",)])
def test_answers_are_those_of_the_postings(spark, docs, tmp_path_factory, codes):
    folder = tmp_path_factory.mktemp("index")
    fields = {"title": F.col("title"), "body": F.col("body")}
    search_index.write_index(docs, "id", fields, f"{folder}/i")
    index = search_index.read_index(spark, f"{folder}/i")
    post = fielded.fielded_postings(docs, "id", fields)
    assert (index.n_docs, index.avg_length) == tuple(fielded.totals(docs, post).first()) and index.n_docs == 301
    for groups in QUERIES:
        want = fielded.scored(post, fielded.totals(docs, post), fielded.Parsed("", tuple(groups), codes))
        got = search_index.answer(index, groups, codes)
        rows = [sorted((r.doc, round(r.score, 9)) for r in df.collect()) for df in (want, got)]
        assert rows[0] == rows[1]


def test_an_index_is_written_once_for_a_table(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/docs")
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    fields = {"title": F.col("title")}
    first = search_index.stored_index(read(), "id", fields, f"{tmp_path}/kept", "titles")
    paths = first.postings.inputFiles()
    assert search_index.stored_index(read(), "id", fields, f"{tmp_path}/kept", "titles").postings.inputFiles() == paths
    docs.where("id < 9").write.mode("append").parquet(f"{tmp_path}/docs")
    assert search_index.stored_index(read(), "id", fields, f"{tmp_path}/kept", "titles").n_docs == 310


def test_empty_tables_and_long_bodies(spark, docs, tmp_path):
    search_index.write_index(docs.where("false"), "id", {"title": F.col("title")}, f"{tmp_path}/e")
    empty = search_index.read_index(spark, f"{tmp_path}/e")
    assert empty.n_docs == 0 and search_index.answer(empty, QUERIES[0], ("x",)).count() == 0
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    long = spark.createDataFrame([(1, "waa title", " ".join([*words, *words[:3], "title"]))], "id long, title string, body string")
    post = {r.term: r for r in fielded.fielded_postings(long, "id", {"title": F.col("title"), "body": F.col("body")}).collect()}
    # the title's words count in the body, and of the others the first 140
    assert len(post) == 142 and words[140] in post and words[141] not in post
    assert (post["waa"].tf, post["waa"].mask) == (3, 9) and post[words[1]].tf == 2 and post["title"].tf == 2
