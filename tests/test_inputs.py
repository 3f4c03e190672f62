"""Whole inputs: equal ends, folder tables, headers in any order, and daily totals that repeat."""

import pytest
from pyspark.sql import functions as F

from palaver.operators.lookups import newest_first
from palaver.operators.sessions import capped_sessions
from palaver.operators.voices import best_and_second
from palaver.sources.journal_csv import checked, read_csv
from palaver.sources.tables import upsert_daily
from palaver.streaming.runtime import run_append, table_stream

S = 1_000_000


def test_of_equal_ends_the_later_row_is_joined(spark):
    rows = [("d", "a", 0, 10 * S), ("d", "b", 5 * S, 10 * S), ("d", "c", 12 * S, 14 * S), ("d", "e", 13 * S, 14 * S), ("d", "f", 15 * S, 16 * S)]
    df = spark.createDataFrame(rows, "device_id string, segment_id string, start_us long, end_us long")
    got = {r.segment_id: r.session_first for r in capped_sessions(df, max_gap_s=60, max_length_s=3600).collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "e": "e", "f": "e"}


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    spark.range(40).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/part")
    assert run_append(table_stream(spark, str(tmp_path), "events"), "folder").count() == 40
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table_stream(spark, str(tmp_path), "missing")


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,date,end_time,start_time\n"two\nlines",2024-01-05,10:00:05,10:00\n')
    row = checked(read_csv(spark, str(tmp_path / "a.csv"))).first()
    assert (row.text, row.language, row.speaker, row.engine, row.violations) == ("two\nlines", None, None, None, [])
    (tmp_path / "b.csv").write_text("text,date,end_time\nx,2024-01-05,10:00\n")
    with pytest.raises(ValueError, match="start_time"):
        read_csv(spark, str(tmp_path / "b.csv"))


def test_pages_have_no_hidden_cap(spark):
    df = spark.range(450).select(F.lit("2024-01-01").alias("date"), F.col("id").alias("start_us"), F.col("id").alias("conversation_id"))
    assert newest_first(df, 400).count() == 400 and newest_first(df, 400, max_limit=200).count() == 200


def test_shards_give_the_same_voices(spark, monkeypatch):
    from palaver.operators import voices

    def vec(i, n):
        return [float((i * 7 + j * 3) % 11 - 5) for j in range(n)]

    vectors = spark.createDataFrame([(i, vec(i, 8)) for i in range(60)], "vec_id long, embedding array<double>")
    protos = spark.createDataFrame([(f"v{i % 9}", vec(i + 100, 8)) for i in range(30)], "name string, embedding array<double>")
    whole = best_and_second(vectors, protos).orderBy("vec_id").collect()
    monkeypatch.setattr(voices, "SHARD", 4)
    assert best_and_second(vectors, protos, broadcast_elements=0).orderBy("vec_id").collect() == whole


def test_a_repeated_batch_changes_no_total(spark, tmp_path):
    rows = [("a", 0, 5 * S, "2024-01-01"), ("b", 7 * S, 9 * S, "2024-01-01"), ("c", 0, S, "2024-01-02")]
    df = spark.createDataFrame(rows, "segment_id string, start_us long, end_us long, date string")
    path = f"{tmp_path}/daily"
    once = sorted(map(tuple, upsert_daily(spark, path, df).collect()))
    assert sorted(map(tuple, upsert_daily(spark, path, df.where("segment_id <> 'c'")).collect())) == once
    assert once == [(S, 1, 0, S, "2024-01-02"), (7 * S, 2, 0, 9 * S, "2024-01-01")]


def test_profile_shards_give_the_same_speaker(spark):
    from palaver.operators.voices import zscore_match

    features = spark.createDataFrame([(i, i % 13 / 2.0 + 0.1, i % 7 / 3.0 + 0.1, 0.5) for i in range(40)], "k int, pitch double, centroid double, voiced_ratio double")
    profiles = spark.createDataFrame([(f"p{i}", i / 3.0, 0.2 + i % 3 / 10, i / 5.0, 0.3, 2.0) for i in range(20)], "name string, pitch_mean double, pitch_std double, centroid_mean double, centroid_std double, multiplier double")
    one = sorted(map(tuple, zscore_match(features, profiles, "k").collect()))
    assert sorted(map(tuple, zscore_match(features, profiles, "k", shard_profiles=6).collect())) == one


def test_equal_averages_of_languages_go_by_name(spark, tmp_path):
    from palaver.plans import catalogue

    # The same values in two orders, whose floating point sums differ.
    rows = [(0, 83), (3, 2), (6, 1), (9, 3), (12, 69), (1, 2), (4, 3), (7, 83), (10, 69), (13, 1)]
    made = ", ".join(f"({i}L, TIMESTAMP '2024-01-01 00:00:00', 5L, 'view', 2.0D, '{{\"k\": {k}}}')" for i, k in rows)
    events = spark.sql(f"SELECT * FROM VALUES {made} AS e(event_id, ts, user_id, event_type, value, props)")
    events.repartition(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["conversation_language_avg"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("dev-0", "en:316000,hi:316000")]
