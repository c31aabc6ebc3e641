import random

import pytest
from pyspark.sql import functions as F

from headrow.functions.text import title_search
from headrow.operators.search import TitleIndex

TITLES = ["100% sure", "100 percent", "a_b", "a\\b", "AB", "Straße ÄÖ", "strasse äö", "", None, "x", "The End", "the end of the THE", "日本語の見出し", "aaa", "aaaa"]
QUERIES = ["%", "_", "\\", "", "a", "ab", "100%", "00 p", "THE", "the e", "STRASSE", "ß Ä", "ß ä", "本語の", "本", "aaa", "zzzz", "the end of the the"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = TitleIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", buckets=4)
    rows = [(i, t) for i, t in enumerate(TITLES)]
    made.add(spark.createDataFrame([(i, "the end " + (t or "")) for i, t in rows if i % 2], "item_id long, title string"), 0)
    made.add(spark.createDataFrame(rows, "item_id long, title string"), 1)
    made.add(spark.createDataFrame([(0, "not committed again")], "item_id long, title string"), 1)
    return made


@pytest.mark.parametrize("text", QUERIES)
def test_index_equals_the_scan(spark, index, text):
    rows = [(i, t if t is not None else "the end ") for i, t in enumerate(TITLES) if t is not None or i % 2]
    scan = spark.createDataFrame(rows, "item_id long, title string").where(title_search(F.col("title"), text))
    assert sorted(map(tuple, index.search(text).select("item_id", "title").collect())) == sorted(map(tuple, scan.collect()))


def test_random_titles_and_plan(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abC ") for _ in range(rnd.randrange(12)))) for i in range(400)]
    made = TitleIndex(spark, f"file://{tmp_path}/i", buckets=4)
    assert made.search("abc").count() == 0
    made.add(spark.createDataFrame(rows, "item_id long, title string"), 0)
    for text in ("abc", "Ca b", "aab"):
        assert {r.item_id for r in made.search(text).collect()} == {i for i, t in rows if text.lower() in t.lower()}
    plan = made.postings(made.log.snapshot(), ["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan, plan
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)]" in plan, plan
