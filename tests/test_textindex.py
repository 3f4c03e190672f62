import random

import pytest

from palaver.operators import textindex
from palaver.operators.search import bm25_search
from palaver.operators.textindex import TextIndex

WORDS = ["the", "then", "theory", "of", "café", "cafe", "12", "x", "日本", "naïve", "a-b", "it's"]


def rows_of(df):
    return [(r.id, round(r["rank"], 9)) for r in df.collect()]


def texts(seed, n=90):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, k=r.choice([0, 1, 3, 12, 60, 300]))), r.choice([None, "of the", "X the"])) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "the " * 5000, "of")]


QUERIES = [("the of", "all"), ("Cafe x", "any"), ("of the", "phrase"), ("the the the", "phrase"), ("of the", "prefix"), ("t", "prefix"), ("日本 b", "any"), ("nothing here", "any"), ("", "all")]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = texts(1)
    df = spark.createDataFrame(rows, "id long, a string, b string")
    old = spark.createDataFrame([(i, "of the cafe x", "the") if i % 5 == 0 else (i, a, b) for i, a, b in rows if i % 3], df.schema)
    new = [r for r in rows if r[0] % 3 == 0 or r[0] % 5 == 0]
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), ["a", "b"], "id", "bigint")
    assert index.search("the").count() == 0
    index.add(old, 1)
    index.add(spark.createDataFrame(new[::2], df.schema), 2)
    for _ in range(2):
        index.add(spark.createDataFrame(new[1::2], df.schema), 3)
    return df, index


@pytest.mark.parametrize("query, mode", QUERIES)
def test_modes_equal_a_scan(indexed, query, mode):
    df, index = indexed
    want = bm25_search(df, query, ["a", "b"], "id", mode, 20, 3)
    assert rows_of(index.search(query, mode, 20, 3)) == rows_of(want)


@pytest.mark.parametrize("query, mode", [("the of", "all"), ("cafe x", "any"), ("theory", "any")])
def test_classes_without_a_best_row_are_left_out(spark, tmp_path, monkeypatch, query, mode):
    monkeypatch.setattr(textindex, "FIRST", 1)
    df = spark.createDataFrame(texts(2, 300), "id long, a string, b string")
    index = TextIndex(spark, str(tmp_path), ["a", "b"], "id", "bigint")
    index.add(df, 0)
    for limit in (1, 5):
        assert rows_of(index.search(query, mode, limit)) == rows_of(bm25_search(df, query, ["a", "b"], "id", mode, limit))
    plan = index.search("theory", "any", 1)._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:200]
