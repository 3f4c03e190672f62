import pytest
from pyspark.sql import functions as F

from palaver.sources.stored import StoredTable

SCHEMA = "id bigint, name string, n int"


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path), SCHEMA, "id", buckets=5)
    t.replace(spark.createDataFrame([(i, f"a{i}", i) for i in range(20)] + [(None, "none", None)], SCHEMA))
    return t


def test_replace_keeps_other_rows_and_old_versions(spark, table):
    before = content(table.read())
    assert table.version() == 1 and len(before) == 21
    assert table.replace(spark.createDataFrame([(3, "new", None), (50, "more", 1)], SCHEMA)) == 2
    rows = {r[0]: r for r in content(table.read())}
    assert rows[3] == (3, "new", None) and rows[50] == (50, "more", 1) and rows[4] == (4, "a4", 4) and len(rows) == 22
    assert content(table.read(1)) == before
    first, second = table._places(1), table._places(2)
    assert 0 < sum(first[b] == second[b] for b in first) < 5


def test_a_repeat_makes_no_version(spark, table):
    change = spark.createDataFrame([(3, "new", 9)], SCHEMA)
    assert table.replace(change) == 2 == table.replace(change) == table.version()
    assert table.replace(change.limit(0)) == 2


def test_update_reports_absent_keys(spark, table):
    changes = spark.createDataFrame([(1, "x"), (2, None), (99, "y")], "id bigint, name string")
    version, absent = table.update(changes)
    assert version == 2 and content(absent) == [(99,)]
    rows = {r[0]: r for r in content(table.read())}
    assert rows[1] == (1, "x", 1) and rows[2] == (2, None, 2) and 99 not in rows and len(rows) == 21
    assert table.update(changes)[0] == 2


def test_remove(spark, table):
    assert table.remove(spark.createDataFrame([(i,) for i in range(19)] + [(77,)], "id bigint")) == 2
    assert content(table.read()) == [(19, "a19", 19), (None, "none", None)]
    table.remove(spark.createDataFrame([(19,)], "id bigint"))
    assert content(table.read()) == [(None, "none", None)]


def test_a_failed_write_changes_nothing(spark, table):
    before = content(table.read())
    bad = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], SCHEMA).withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken"):
        table.replace(bad)
    assert table.version() == 1 and content(table.read()) == before
    assert table.replace(spark.createDataFrame([(1, "x", 1)], SCHEMA)) == 2


def test_two_writers_of_one_version(spark, table, monkeypatch):
    other = StoredTable(spark, table.folder, SCHEMA, "id", buckets=5)
    table.replace(spark.createDataFrame([(1, "x", 1)], SCHEMA))
    monkeypatch.setattr(other, "version", lambda: 1)
    with pytest.raises(RuntimeError):
        other.replace(spark.createDataFrame([(2, "y", 2)], SCHEMA))
    assert {r[0]: r for r in content(table.read())}[2] == (2, "a2", 2)
