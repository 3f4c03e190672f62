import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    got = rows_of(QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(con.execute(ORACLES[name]).df())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_return_documents(stages):
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns
    counts = [d.count() for d in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_stages_take_effect(spark, stages):
    start, lang, lines, join, clean, packed = stages
    assert lang.count() >= 0.98 * start.count()
    seen = [x for r in lines.collect() for x in r.text.split("\n") if x.strip()]
    assert len(seen) == len(set(seen)) and all(r.n_chars == len(r.text) for r in lines.collect())
    from palaver.llm import decontaminate, jaccard_join

    assert jaccard_join.jaccard_join(join).where("doc_id != class_id").count() == 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.leaks(clean, items).count() == 0
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in packed.collect()}


def test_only_leaking_rows_go(spark, stages):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item, "en", "s", 1), (None, "clean", "en", "s", 1), (5, "x " + item, "en", "s", 1), (5, "", "en", "s", 1), (6, None, None, None, None)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    got = corpus_pipeline.uncontaminated(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("5", ""), ("6", "None"), ("None", "clean")]


def test_stages_with_clashing_names_nulls_and_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["n_lines", "n_removed", "_lang", "_score", "_id", "_text", "_key", "_h", "_one", "_n", "input", "key"]
    more = docs.limit(40).select("*", *(F.lit(n).alias(n) for n in names))
    more = more.unionByName(more.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in more.schema)))
    for start in (more, more.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            now = spark.createDataFrame(now.collect(), start.schema)
            assert now.columns == start.columns
            assert now.where(" or ".join(f"{n} != '{n}'" for n in names)).count() == 0
        assert now.count() <= start.count()
