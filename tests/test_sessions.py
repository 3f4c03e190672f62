import random

from pyspark.sql import functions as F

from palaver.operators import sessions as S
from palaver.operators.intervals import chunk_at_silence, range_join, words_in_core
from palaver.operators.ordered import fit_slot, running
from palaver.operators.transcripts import conversation_rollup, ordered_parts
from palaver.streaming.stateful import capped_step

DDL = "device_id string, segment_id string, start_us bigint, end_us bigint, speaker string, language string"
BASE = 1_700_000_000_000_000


def seg(spark, spans, device="d", speaker="owner"):
    rows = [
        (device, f"s{i:04d}", BASE + int(a * 1e6), BASE + int(b * 1e6), speaker, "en")
        for i, (a, b) in enumerate(spans)
    ]
    return spark.createDataFrame(rows, DDL)


def noisy(n, seed, spread=40.0, devices=1):
    r = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t += r.random() * spread
        out.append((f"d{r.randrange(devices)}", f"s{i:04d}", BASE + int(t * 1e6), BASE + int((t + r.random() * 30) * 1e6), r.choice(["owner", "partner", "unknown"]), "en"))
    return out


def test_gap_at_threshold_merges_and_more_does_not(spark):
    assert S.merge_segments(seg(spark, [(0, 2), (4.5, 6)])).count() == 1
    assert S.merge_segments(seg(spark, [(0, 2), (4.6, 6)])).count() == 2


def test_empty_and_short_units(spark):
    assert S.merge_segments(seg(spark, [])).count() == 0
    row = S.merge_segments(seg(spark, [(0, 1)])).first()
    assert row.merge_count == 1 and row.speech_ratio == 1.0


def test_merge_statistics(spark):
    row = S.merge_segments(seg(spark, [(0, 2), (3, 5), (6, 8), (9, 11), (12, 14)])).first()
    assert (row.merge_count, row.gaps_merged, row.total_gap_us) == (5, 4, 4_000_000)
    assert abs(row.speech_ratio - 10 / 14) < 1e-9 and row.avg_source_s == 2.0


def test_overlap_stays_in_one_unit(spark):
    row = S.merge_segments(seg(spark, [(0, 5), (3, 8)])).first()
    assert row.merge_count == 2 and row.gaps_merged == 0


def test_long_single_segment_is_cut(spark):
    parts = S.split_units(seg(spark, [(0, 60)]), max_unit_s=30).collect()
    assert len(parts) >= 2
    assert all(p.end_us - p.start_us <= 30_500_000 for p in parts)


def split_by_hand(spans, limit):
    if spans[-1][1] - spans[0][0] <= limit or len(spans) == 1:
        return [spans]
    middle = spans[0][0] + (spans[-1][1] - spans[0][0]) / 2
    cut = min(range(len(spans) - 1), key=lambda i: abs(spans[i][1] - middle))
    return split_by_hand(spans[: cut + 1], limit) + split_by_hand(spans[cut + 1 :], limit)


def test_split_units_against_recursion(spark):
    spans, t, r = [], 0.0, random.Random(5)
    for _ in range(60):
        d = 1 + r.random() * 8
        spans.append((round(t, 3), round(t + d, 3)))
        t += d + r.random() * 2
    got = S.split_units(seg(spark, spans), max_unit_s=20).orderBy("start_us").collect()
    want = split_by_hand(spans, 20)
    assert [(g.start_us, g.end_us, g.merge_count) for g in got] == [
        (BASE + int(w[0][0] * 1e6), BASE + int(w[-1][1] * 1e6), len(w)) for w in want
    ]


def test_running_equals_plain_loop_for_any_slot(spark):
    rows = noisy(300, 1, devices=2)
    df = spark.createDataFrame(rows, DDL)
    for slot in (1_000_000, 60_000_000, 10**12):
        got = {
            r.segment_id: (r.last_end, r.top, r.n)
            for r in running(
                df,
                ["device_id"],
                ["start_us", "segment_id"],
                {
                    "last_end": ("last", F.col("end_us")),
                    "top": ("max", F.col("end_us")),
                    "n": ("sum", F.lit(1).cast("bigint")),
                },
                slot_us=slot,
            ).collect()
        }
        seen = {}
        for d, i, s, e, *_ in sorted(rows, key=lambda x: (x[2], x[1])):
            ends = seen.setdefault(d, [])
            assert got[i] == (ends[-1] if ends else None, max(ends) if ends else None, len(ends))
            ends.append(e)


def test_capped_sessions_against_fold(spark):
    for seed, spread in ((2, 25.0), (3, 12.0), (4, 60.0)):
        rows = noisy(400, seed, spread, devices=2)
        df = spark.createDataFrame(rows, DDL)
        got = {
            r.segment_id: r.session_first
            for r in S.capped_sessions(df, max_length_s=120.0, slot_us=50_000_000).collect()
        }
        states = {}
        for d, i, s, e, *_ in sorted(rows, key=lambda x: (x[2], x[1])):
            want = capped_step(states.setdefault(d, {}), i, s, e, 12_000_000, 120_000_000)
            assert got[i] == want[1]


def test_saved_clips_share_a_conversation(spark):
    rows = seg(spark, [(0, 3), (4, 7), (25, 28)])
    s = S.capped_sessions(rows)
    assert {r.segment_id: r.session_first for r in s.collect()} == {"s0000": "s0000", "s0001": "s0000", "s0002": "s0002"}
    turns = s.withColumn("conv_id", F.col("session_first")).withColumn("text", F.col("segment_id"))
    turns = turns.withColumn("status", F.lit("ok")).withColumn(
        "speaker", F.when(F.col("segment_id") == "s0000", "zoe").otherwise("amy")
    )
    first = conversation_rollup(turns).filter("conv_id = 's0000'").first()
    assert first.transcript == "s0000\ns0001" and first.duration_seconds == 7.0
    assert first.participants == ["zoe", "amy"] and first.quality == "ok"


def test_imported_rows_stand_alone(spark):
    rows = seg(spark, [(0, 3), (4, 7), (8, 9)]).withColumn("imported", F.col("segment_id") == "s0001")
    got = {r.segment_id: r.session_first for r in S.capped_sessions(rows).collect()}
    assert got == {"s0000": "s0000", "s0001": "s0001", "s0002": "s0000"}


def test_every_segment_is_in_one_unit(spark):
    df = spark.createDataFrame(noisy(500, 9, devices=3), DDL)
    units = S.merge_segments(df, slot_us=100_000_000)
    assert units.agg(F.sum("merge_count")).first()[0] == 500


def test_parts_cut_long_lists_and_keep_them_whole(spark):
    rows = [("c", i, BASE + i * 1_000_000) for i in range(25)]
    df = spark.createDataFrame(rows, "conv string, i int, start_us bigint")
    parts = ordered_parts(df, ["conv"], ["start_us", "i"], part_rows=10, v=F.col("i")).orderBy("part").collect()
    assert [len(p["items"]) for p in parts] == [10, 10, 5]
    assert [x.v for p in parts for x in p["items"]] == list(range(25))


def test_range_join_against_all_pairs(spark):
    r = random.Random(3)
    a = [("k", i, s, s + r.randrange(1, 90)) for i, s in enumerate(r.randrange(1000) for _ in range(60))]
    b = [("k", i, s, s + r.randrange(1, 20)) for i, s in enumerate(r.randrange(1000) for _ in range(80))]
    left = spark.createDataFrame(a, "k string, i int, a0 bigint, a1 bigint")
    right = spark.createDataFrame(b, "k string, j int, b0 bigint, b1 bigint")
    got = sorted((x.i, x.j) for x in range_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 25).collect())
    assert got == sorted((i, j) for _, i, s, e in a for _, j, p, q in b if s < q and e > p)


def test_words_belong_to_the_core_of_their_middle(spark):
    words = [("yes", 0.0, 0.6), ("yes,", 0.6, 0.9), ("आज!", 0.9, 1.0)]
    df = spark.createDataFrame([(words,), ([],)], "w array<struct<word string, start double, end double>>")

    def own(a, b):
        c = words_in_core(df, F.col("w"), F.lit(a), F.lit(b), 16_000)
        return [tuple(r) for r in df.select(c["text"], c["status"]).collect()]

    assert own(0, 8000)[0] == ("yes", "")
    assert own(8000, 16_000)[0] == ("yes, आज!", "")
    assert own(0, 8000)[1][1] == "boundary_timestamps_missing"


def test_snapped_chunks_cover_the_clip(spark):
    clips = spark.createDataFrame([("a", 50.0)], "clip string, duration double")
    bounds = spark.createDataFrame([("a", 13.0), ("a", 31.0)], "clip string, boundary double")
    got = [(r.start, r.end) for r in chunk_at_silence(clips, bounds, "clip", snap=True).orderBy("start").collect()]
    assert got == [(0.0, 13.0), (13.0, 31.0), (31.0, 46.0), (46.0, 50.0)]
    plain = [(r.start, r.end) for r in chunk_at_silence(clips, bounds, "clip").orderBy("start").collect()]
    assert plain == [(0.0, 15.0), (15.0, 30.0), (30.0, 45.0), (45.0, 50.0)]


def test_fit_slot_narrows_for_dense_keys(spark):
    df = spark.createDataFrame([("a", BASE + i) for i in range(1000)], "k string, start_us bigint")
    assert fit_slot(df, ["k"], "start_us", 100) == 360_000_000


def test_rows_with_a_null_key_stay(spark):
    rows = [(None, f"s{i}", BASE + i * 1_000_000, BASE + i * 1_000_000 + 500_000, "owner", "en") for i in range(5)]
    df = spark.createDataFrame(rows, DDL)
    out = running(df, ["device_id"], ["start_us", "segment_id"], {"n": ("sum", F.lit(1).cast("bigint"))}, slot_us=2_000_000)
    assert sorted(r.n for r in out.collect()) == [0, 1, 2, 3, 4]
    assert S.merge_segments(df, slot_us=2_000_000).first().merge_count == 5
