import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.plans import catalogue
from palaver.streaming import flows, runtime, stateful
from palaver.streaming.stateful import UnitRules, cut_run

SF = "/root/testdata/sf0.001"
RULES = UnitRules(0.5, 12.0, 24.0, 0.6, 0.5)


def as_stream(spark, df, path, parts):
    """``df`` as a stream that brings the rows of one value of the column ``parts`` in each batch, in its order."""
    for n in sorted(r[0] for r in df.select(parts).distinct().collect()):
        df.where(F.col(parts) == n).drop(parts).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.drop(parts).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def state_rows(stream, marks, path):
    """Rows of state that the stream leaves after its end mark, and the batches that it took."""
    for last in (False, True):
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check")
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        if not last:
            batches, held = len(q.recentProgress), [s.numRowsTotal for s in q.lastProgress.stateOperators]
            marks.set()
    return batches, sum(held), sum(s.numRowsTotal for s in q.lastProgress.stateOperators)


def shuffled(df, slices=6):
    """``part``: the slice of time of a row, or for a third of the rows the next one; ``delay`` covers both."""
    low, high = df.agg(F.min("start_us"), F.max("start_us")).first()
    width = (high - low) // slices + 1
    late = F.when(F.pmod(F.xxhash64("start_us"), F.lit(3)) == 0, 1).otherwise(0)
    return df.withColumn("part", ((F.col("start_us") - low) / width).cast("int") + late), f"{2 * width // 1_000_000 + 1} seconds"


def test_stream_equals_batch_for_capped_sessions(spark):
    a = catalogue.QUERIES["capped_session_stream"](spark, SF)
    b = catalogue.QUERIES["capped_sessions"](spark, SF)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_quota_stream_against_recount(spark):
    from palaver.plans.q_streams import answer_rows
    from palaver.plans.registry import Tables

    got = {r.request_id: r.verdict for r in catalogue.QUERIES["quota_stream"](spark, SF).collect()}
    usage = Tables(spark, SF).usage
    assert len(got) == usage.count() and {"admit", "paced", "cooling"} <= set(got.values())
    asked = [(r.start_us, 0, r.request_id, r) for r in usage.collect()]
    came = [(r.start_us, 1, r.request_id, r) for r in answer_rows(usage).collect()]
    kept, pause = {}, {}
    for now, answer, i, r in sorted(asked + came, key=lambda x: x[:3]):
        mine = kept.setdefault(r.account, [])
        if answer:
            if any(k == i for _, _, _, k in mine):
                wait = {None: 30, 401: 300}.get(r.status) or {"900": 900, "1": 5, "soon": 60, None: 30}[r.retry_header]
                pause[r.account] = now + wait * 1_000_000
            continue
        hour = sum(b for t, b, _, _ in mine if t > now - 3_600_000_000)
        day = [(t, b) for t, b, d, _ in mine if d == r.day]
        minute = sum(1 for t, _, _, _ in mine if t > now - 60_000_000)
        if pause.get(r.account, 0) > now:
            want = "cooling"
        elif len(day) + 1 > 1800 or sum(b for _, b in day) + r.billed_seconds > 25_920 or hour + r.billed_seconds > 1350:
            want = "budget"
        elif minute + 1 > 1.8:
            want = "paced"
        else:
            want = "admit"
            mine.append((now, r.billed_seconds, r.day, i))
        assert got[i] == want


def test_cooling_after_an_outage():
    state = {"retry_us": 5_000_000}
    assert stateful.admit_step(state, 1_000_000, 3.0, **stateful.DEFAULT_LIMITS) == ("cooling", 4.0)
    assert stateful.admit_step(state, 6_000_000, 3.0, **stateful.DEFAULT_LIMITS)[0] == "admit"


def test_cores_cover_continuous_speech_once():
    r = random.Random(4)
    units, at, core = cut_run(np.array([r.random() for _ in range(240)]), np.ones(240, bool), 0, RULES, True)
    assert units[0][2] == 0 and units[-1][3] == 240 and (at, core) == (240, 0)
    assert all(a[3] == b[2] for a, b in zip(units, units[1:]))
    assert all(u[1] - u[0] <= 48 for u in units)


def test_ends_of_runs_and_silence():
    short = cut_run(np.full(4, 0.5), np.ones(4, bool), 0, RULES, True)[0]
    assert short == [(0, 4, 0, 4)]
    assert cut_run(np.zeros(60), np.zeros(60, bool), 0, RULES, True)[0] == []
    assert cut_run(np.zeros(60), np.zeros(60, bool), 0, RULES, False) == ([], 48, 0)
    assert cut_run(np.zeros(0), np.zeros(0, bool), 0, RULES, True) == ([], 0, 0)


def plain_units(frames):
    """Frame by frame: (time, energy, speech) of one device in order, the rest given out at the end."""
    units, have, core, start = [], [], 0, None

    def rest():
        if len(have) > core and any(s for _, s in have):
            units.append((start, start + len(have), start + core, start + len(have)))

    for t, e, s in frames:
        if have and t != start + len(have):
            rest()
            have, core = [], 0
        if not have:
            start = t
        have.append((e, s))
        n = len(have)
        if n < 24:
            continue
        quiet = next((i for i, f in enumerate(reversed(have)) if f[1]), None)
        if quiet is None:
            have, core = [], 0
        elif n == 48:
            cut = min(range(44, 47), key=lambda i: (have[i][0], i)) + 1
            units.append((start, start + min(n, cut + 1), start + core, start + cut))
            have, start, core = have[cut - 1 :], start + cut - 1, 1
        elif quiet >= 2:
            units.append((start, start + n, start + core, start + n))
            have, core = [], 0
    rest()
    return units


@pytest.mark.parametrize("seed", range(8))
def test_units_in_pieces_equal_frame_by_frame(seed):
    r = random.Random(seed)
    times, t = [], 0
    while len(times) < 700:
        t += 1 if r.random() > 0.01 else r.randint(2, 50)
        times.append(t)
    p = r.choice([0.02, 0.3, 0.9, 1.0])
    frames = [(t, r.random(), r.random() < p) for t in times]
    fold = stateful.BoundedUnits(RULES, 500_000, 25_000)
    state, got = None, []
    while frames:
        n = r.randint(1, 90)
        piece, frames = frames[:n], frames[n:]
        state, units = fold.fold(state, [(t * 500_000, e, s) for t, e, s in piece])
        got += units
    got += fold.finish(state) if state is not None else []
    r = random.Random(seed)
    times2, t = [], 0
    while len(times2) < 700:
        t += 1 if r.random() > 0.01 else r.randint(2, 50)
        times2.append(t)
    p = r.choice([0.02, 0.3, 0.9, 1.0])
    frames = [(t, r.random(), r.random() < p) for t in times2]
    assert [tuple(x // 500_000 for x in u) for u in got] == plain_units(frames)
    spoken = [t for t, _, s in frames if s]
    cores = sorted(x for u in got for x in range(u[2] // 500_000, u[3] // 500_000))
    assert len(cores) == len(set(cores)) and set(spoken) <= set(cores)


def test_units_stream_keeps_every_spoken_frame(spark):
    from palaver.plans.q_streams import frame_rows
    from palaver.plans.registry import Tables

    units = catalogue.QUERIES["bounded_units_stream"](spark, SF)
    frames = frame_rows(Tables(spark, SF).segments)
    inside = (F.col("f.start_us") >= F.col("core_start_us")) & (F.col("f.start_us") < F.col("core_end_us"))
    met = frames.where("speech").alias("f").join(units.alias("u"), F.expr("f.device_id = u.device_id") & inside, "left")
    counts = met.groupBy("f.device_id", "f.start_us").agg(F.count("core_start_us").alias("n"))
    assert counts.where("n != 1").count() == 0 and counts.count() == frames.where("speech").count()


def test_units_over_shuffled_batches(spark, tmp_path):
    runtime.prepare(spark)
    r = random.Random(1)
    rows = [(f"d{d}", (1000 + d * 7 + i + (i // 150) * 40) * 500_000, r.random(), r.random() < 0.8) for d in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "device_id string, start_us bigint, energy double, speech boolean")
    parted, delay = shuffled(df)
    marks = runtime.EndMarks(spark)
    out = stateful.bounded_units_stream(marks.join(as_stream(spark, parted, tmp_path / "in", "part")), delay=delay)
    batches, held, left = state_rows(out, marks, tmp_path)
    assert batches >= 6 and held > 0 and left == 0
    got = {}
    for x in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(x.device_id, []).append(tuple(v // 500_000 for v in x[1:]))
    for d in range(3):
        frames = sorted((t // 500_000, e, s) for k, t, e, s in rows if k == f"d{d}")
        assert sorted(got[f"d{d}"]) == plain_units(frames)


def test_capped_sessions_over_shuffled_batches(spark, tmp_path):
    from palaver.plans.q_sessions import CAP_GAP, CAP_LEN
    from palaver.plans.registry import Tables

    runtime.prepare(spark)
    seg = Tables(spark, SF).segments.select("device_id", "segment_id", "start_us", "end_us")
    parted, delay = shuffled(seg)
    marks = runtime.EndMarks(spark)
    source = marks.join(as_stream(spark, parted, tmp_path / "in", "part"))
    out = stateful.capped_session_stream(source, CAP_GAP, CAP_LEN / 60, delay=delay)
    batches, held, left = state_rows(out, marks, tmp_path)
    assert batches >= 6 and held > 0 and left == 0
    want = catalogue.QUERIES["capped_sessions"](spark, SF)
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    runtime.prepare(spark)
    hour = 3_600_000_000
    rows = [("d", "a", hour, hour + 1, 0), ("d", "c", 3 * hour, 3 * hour + 1, 1), ("d", "b", 3 * hour - 1, 3 * hour, 2), ("d", "late", hour, hour + 1, 3)]
    df = spark.createDataFrame(rows, "device_id string, segment_id string, start_us bigint, end_us bigint, part int")
    marks = runtime.EndMarks(spark)
    out = stateful.capped_session_stream(marks.join(as_stream(spark, df, tmp_path / "in", "part")))
    state_rows(out, marks, tmp_path)
    got = {r.segment_id: r.session_first for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a": "a", "b": "b", "c": "b"}


@pytest.mark.parametrize(
    "status, header, pause",
    [(200, None, 0), (399, "9", 0), (429, None, 30), (429, "120", 120), (500, "1", 5), (503, "999999", 86400)]
    + [(429, "soon", 60), (401, "7", 300), (403, None, 300), (None, None, 30)],
)
def test_pauses(status, header, pause):
    assert stateful.pause_after(status, header) == pause


def test_only_admitted_requests_bring_a_pause():
    state = {}
    assert stateful.admit_step(state, 0, 3.0, request_id=1, **stateful.DEFAULT_LIMITS)[0] == "admit"
    stateful.respond_step(state, 1_000_000, 2, 429, "100")
    assert stateful.admit_step(state, 2_000_000, 3.0, request_id=3, **stateful.DEFAULT_LIMITS)[0] == "admit"
    stateful.respond_step(state, 3_000_000, 1, 429, "100")
    assert stateful.admit_step(state, 4_000_000, 3.0, request_id=4, **stateful.DEFAULT_LIMITS) == ("cooling", 99.0)
    assert stateful.admit_step(state, 103_000_000, 3.0, request_id=5, **stateful.DEFAULT_LIMITS)[0] == "admit"


def test_balances_over_batches_and_a_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "COMPACT", 2)
    schema = "device_id string, waiting_us bigint, segment_count bigint"
    batches = [[("a", 5, 1), ("b", 7, 2)], [("a", 9, 2)], [("a", 8, 2), ("c", 30_000_000_000, 1)], [("b", 8, 3), ("a", 8, 2)], [("a", 10, 3)]]
    want = {
        0: {("a", 5, False), ("b", 7, False)},
        1: {("a", 9, True), ("b", 7, False)},
        2: {("a", 8, False), ("b", 7, False), ("c", 30_000_000_000, False)},
        3: {("a", 8, False), ("b", 8, True), ("c", 30_000_000_000, False)},
        4: {("a", 10, True), ("b", 8, True), ("c", 30_000_000_000, False)},
    }
    base = str(tmp_path)

    def seen(n):
        return {(r.device_id, r.waiting_us, r.growing) for r in flows.balances(spark, base, n).collect()}

    for n, rows in enumerate(batches):
        flows.store_balances(spark.createDataFrame(rows, schema), n, base)
        assert seen(n) == want[n]
    for n in (1, 2, 4):
        flows.store_balances(spark.createDataFrame(batches[n], schema), n, base)
        assert seen(n) == want[n]
    assert seen(4) == want[4]
    assert flows.balances(spark, base, 4).where("is_overflow").count() == 1


def test_repeats_are_dropped_and_a_second_run_changes_nothing(spark):
    df = catalogue.QUERIES["dedupe_stream"](spark, SF)
    assert df.count() == df.select("segment_id").distinct().count() == 1000


def test_broken_files_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segment_id":"a","duration_seconds":2.0,"sample_rate":16000,"captured_at":"2"}\n{"seg\n')
    base = flows.quarantine(flows.stage_stream(spark, str(tmp_path)))
    assert spark.read.parquet(f"{base}/ready").count() == 1
    assert spark.read.parquet(f"{base}/broken").count() == 1


def test_daily_totals_over_two_batches(spark, tmp_path):
    rows = [("2024-01-01", f"s{i}", i * 10, i * 10 + 5) for i in range(6)]
    df = spark.createDataFrame(rows, "date string, segment_id string, start_us bigint, end_us bigint")
    for n in (0, 1):
        df.filter(F.col("start_us") % 20 == n * 10).coalesce(1).write.parquet(str(tmp_path / f"p{n}.parquet"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p*"))
    out = spark.read.parquet(flows.daily_rollup_stream(stream)).first()
    assert (out.speech_us, out.segment_count, out.first_us, out.last_us) == (30, 6, 0, 55)
    runtime.prepare(spark)
