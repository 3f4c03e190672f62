import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# These have no SQL: their results are checked against plain loops in the other tests.
NO_SQL = {"asr_eval"}
SAMPLE = (
    "merge_segments split_units quota_stream group_conversations capped_sessions weekly_summary conversation_payload review_flags "
    "quality_score assess_status candidate_terms bm25_search best_and_second span_voting rolling_quota "
    "timeline_layout import_csv export_csv render_note daily_rollup_stream session_stream"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def test_every_query_has_sql_or_a_reason():
    bare = set(entry_module.queries()) - set(entry_module.oracle_sql())
    # The optional queries over documents have tests of their own.
    assert {n for n in bare if not re.match(r"op\d+_|pipeline$", n)} == NO_SQL


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["conversation", "unknown_ratio", "source_type"] and df.count() == 120


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = rows_of(entry_module.queries()[name](spark, SF).toPandas())
    assert got == rows_of(con.execute(entry_module.oracle_sql()[name]).df())


def test_asr_eval_rows(spark):
    rows = entry_module.queries()["asr_eval"](spark, SF).collect()
    assert rows and all(0 <= r.wer <= 1 for r in rows)
    assert all(r.deletions == 0 for r in rows if r.system == "dup11")
