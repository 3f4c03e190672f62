"""Keyed folds in event time: capped sessions, bounded speech units, admission control.

Rows of a key wait in state until the watermark has passed them, then they are folded in time order, whatever
batch they came in. A timer releases waiting rows, and closes a key when nothing that is still to come can
change it; a closed key leaves no state. Rows behind the watermark are dropped by Spark. A key is one device or
one account; its rows must be seen in order, so they share a task, and the watermark delay bounds what waits.
Frames of speech are many and their devices may be, so there a key is a share of the devices (``UnitShares``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType

from palaver.streaming.flows import timed
from palaver.streaming.runtime import END_US, WATERMARK

DAY_US = 86_400_000_000
OFFSET_US = 19_800_000_000
HOUR_US, MINUTE_US = 3_600_000_000, 60_000_000
#: Stands for a missing status in the rows of answers.
NO_STATUS = -1


def _in_order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


class Waking(StatefulProcessor):
    def _wake(self, time_us: int, now_us: int) -> None:
        """Keep one timer for the key, the earliest that is asked for; one that has just fired is still listed."""
        time_ms = -(-time_us // 1000)
        set_ = [t for t in self.handle.listTimers() if t * 1000 > now_us]
        if not set_ or min(set_) > time_ms:
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(time_ms)


class EventTimeFold(Waking):
    """Releases rows in order of ``row_schema`` (its first column is the time in microseconds) to ``fold``.

    ``fold`` takes the state of the key, or None, and the ripe rows, and returns the new state, or None, and the
    rows to emit. ``open_until`` is the time after which a state can be closed, ``finish`` what it then emits.
    """

    row_schema = ""
    state_schema = ""
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One element holds all rows that a batch brought, as an array for each column.
        columns = [f.split(" ", 1) for f in self.row_schema.split(", ")]
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{kind}>" for n, kind in columns))
        self.kept = handle.getValueState("kept", self.state_schema)
        self.fields = [f.split()[0] for f in self.row_schema.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[self.fields].itertuples(index=False, name=None)]
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if min(r[0] for r in new) > now:
            self.waiting.appendList([self._packed(new)])
            self._wake(min(r[0] for r in new), now)
        else:
            yield self._advance(key, new, now)

    @staticmethod
    def _packed(rows: list[tuple]) -> tuple:
        return tuple(list(column) for column in zip(*rows, strict=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, new: list[tuple], now_us: int) -> pd.DataFrame:
        held = [r for packed in self.waiting.get() for r in zip(*packed, strict=True)] + new
        ripe, rest = sorted((r for r in held if r[0] <= now_us), key=_in_order), [r for r in held if r[0] > now_us]
        had = self.kept.exists()
        state = self.restore(self.kept.get()) if had else None
        out: list[tuple] = []
        if ripe:
            state, out = self.fold(state, ripe)
        if state is not None and self.open_until(state) <= now_us:
            out = out + self.finish(state)
            state = None
        if rest:
            self.waiting.put([self._packed(rest)])
        elif held:
            self.waiting.clear()
        if state is not None:
            self.kept.update(self.store(state))
        elif had:
            self.kept.clear()
        ends = [r[0] for r in rest] + ([self.open_until(state)] if state is not None else [])
        if ends:
            self._wake(min(ends), now_us)
        return pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def restore(self, row: tuple):
        return tuple(row)

    def store(self, state) -> tuple:
        return tuple(state)

    def fold(self, state, rows: list[tuple]) -> tuple:
        raise NotImplementedError

    def open_until(self, state) -> int:
        raise NotImplementedError

    def finish(self, state) -> list[tuple]:
        return []


def _run(stream: DataFrame, key: str, processor: EventTimeFold, schema: str, delay: str | None) -> DataFrame:
    """``stream`` through the processor; a stream that has a watermark on ``event_time`` passes ``delay`` None."""
    rows = stream if delay is None else timed(stream, delay=delay)
    names = [f.split()[0] for f in processor.row_schema.split(", ")]
    return rows.select(key, *names, "event_time").groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def capped_step(state: dict, ident, start: int, end: int, gap_us: int, cap_us: int) -> tuple:
    """Session (start, first id) of a row, given the row with the greatest end so far."""
    day = (start + OFFSET_US) // DAY_US
    joins = (
        "end" in state
        and state["day"] == day
        and 0 <= start - state["end"] <= gap_us
        and end - state["first_us"] <= cap_us
    )
    session = (state["first_us"], state["first"]) if joins else (start, ident)
    if "end" not in state or end >= state["end"]:
        state.update(end=end, day=day, first_us=session[0], first=session[1])
    return session


class CappedSessions(EventTimeFold):
    """A session is open for the gap after its greatest end: no later row can join it then."""

    row_schema = "start_us bigint, segment_id string, end_us bigint"
    state_schema = "end bigint, day bigint, first_us bigint, first string"
    columns = ["device_id", "segment_id", "start_us", "end_us", "session_start_us", "session_first"]

    def __init__(self, gap_s: float, cap_s: float):
        self.gap_us, self.cap_us = int(gap_s * 1e6), int(cap_s * 1e6)

    def restore(self, row):
        return dict(zip(("end", "day", "first_us", "first"), row, strict=True))

    def store(self, state):
        return state["end"], state["day"], state["first_us"], state["first"]

    def fold(self, state, rows):
        state = state or {}
        return state, [(i, s, e, *capped_step(state, i, s, e, self.gap_us, self.cap_us)) for s, i, e in rows]

    def open_until(self, state):
        return state["end"] + self.gap_us


def capped_session_stream(
    stream: DataFrame, gap_s: float = 12.0, cap_s: float = 1800.0, delay: str | None = WATERMARK
) -> DataFrame:
    """Label the rows of each device with their capped session, once the watermark has passed them."""
    schema = (
        "device_id string, segment_id string, start_us bigint, end_us bigint, "
        "session_start_us bigint, session_first string"
    )
    return _run(stream, "device_id", CappedSessions(gap_s, cap_s), schema, delay)


def admit_step(
    state: dict,
    now_us: int,
    seconds: float,
    per_minute: float,
    hourly_seconds: float,
    daily_requests: float,
    daily_seconds: float,
    fraction: float,
    request_id: int = -1,
) -> tuple[str, float]:
    """Admit, pace or refuse a request. Only admitted requests count against later ones."""
    billed = max(10.0, seconds)
    day = (now_us + OFFSET_US) // DAY_US
    if state.get("day") != day:
        state.update(day=day, n=0, sum=0.0)
    recent = [r for r in state.get("recent", []) if r[0] > now_us - HOUR_US]
    state["recent"] = recent
    if state.get("retry_us", 0) > now_us:
        return "cooling", round((state["retry_us"] - now_us) / 1e6, 6)
    over = (
        state["n"] + 1 > daily_requests * fraction
        or state["sum"] + billed > daily_seconds * fraction
        or sum(r[1] for r in recent) + billed > hourly_seconds * fraction
    )
    if over:
        return "budget", 0.0
    minute = [r[0] for r in recent if r[0] > now_us - MINUTE_US]
    if len(minute) + 1 > per_minute * fraction:
        wait = 61 - (now_us - min(minute)) / 1e6 if minute else 1.0
        return "paced", round(max(1.0, wait), 6)
    recent.append((now_us, billed, request_id))
    state["n"] += 1
    state["sum"] += billed
    return "admit", 0.0


def pause_after(status: int | None, retry_after: str | None) -> float:
    """Seconds without requests after an answer: none below 400, longer when access is refused.

    No status stands for a lost connection. A stated delay is kept between 5 s and a day.
    """
    if status is None:
        return 30.0
    if status < 400:
        return 0.0
    if status in (401, 403):
        return 300.0
    if retry_after is None:
        return 30.0
    try:
        return max(5.0, min(86_400.0, float(retry_after)))
    except ValueError:
        return 60.0


def respond_step(state: dict, now_us: int, request_id: int, status: int | None, retry_after: str | None) -> None:
    """Take in the answer to an admitted request of the last hour; a failure starts or replaces the pause."""
    if any(r[2] == request_id and r[0] > now_us - HOUR_US for r in state.get("recent", [])):
        pause = pause_after(status, retry_after)
        if pause:
            state["retry_us"] = now_us + int(pause * 1e6)


class Admission(EventTimeFold):
    """Requests and answers of one account. Its state is closed when the day, the hour and the pause are over."""

    row_schema = "start_us bigint, answers boolean, request_id bigint, audio_seconds double, status int, retry_header string"
    state_schema = (
        "day bigint, n bigint, total double, retry_us bigint, times array<bigint>, billed array<double>, ids array<bigint>"
    )
    columns = ["account", "request_id", "verdict", "retry_after"]

    def __init__(self, limits: dict):
        self.limits = limits

    def restore(self, row):
        day, n, total, retry_us, times, billed, ids = row
        recent = [(int(t), float(b), int(i)) for t, b, i in zip(times, billed, ids, strict=True)]
        return {"day": day, "n": n, "sum": total, "retry_us": retry_us, "recent": recent}

    def store(self, state):
        times, billed, ids = (list(x) for x in zip(*state["recent"], strict=True)) if state["recent"] else ([], [], [])
        return state["day"], state["n"], state["sum"], state.get("retry_us", 0), times, billed, ids

    def fold(self, state, rows):
        state, out = state or {}, []
        for now, answers, request, seconds, status, header in rows:
            if answers:
                respond_step(state, now, request, None if status == NO_STATUS else status, header)
            else:
                verdict, wait = admit_step(state, now, float(seconds), request_id=request, **self.limits)
                out.append((int(request), verdict, wait))
        return (state if "day" in state else None), out

    def open_until(self, state):
        day_ends = (state["day"] + 1) * DAY_US - OFFSET_US
        last = max((r[0] for r in state["recent"]), default=0)
        return max(day_ends, last + HOUR_US, state.get("retry_us", 0))


DEFAULT_LIMITS = {
    "per_minute": 20,
    "hourly_seconds": 7200,
    "daily_requests": 2000,
    "daily_seconds": 28_800,
    "fraction": 0.9,
}


def with_answers(requests: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Both kinds of events of an account as rows of one stream; at the same time a request comes first.

    ``requests``: account, request_id, start_us, audio_seconds. ``answers``: account, request_id, start_us,
    status (null: no connection), retry_header (the stated delay, null if none).
    """
    asked = requests.select(
        "account", "start_us", F.lit(False).alias("answers"), "request_id", F.col("audio_seconds").cast("double").alias("audio_seconds"),
        F.lit(0).alias("status"), F.lit(None).cast("string").alias("retry_header"),
    )
    if answers is None:
        return asked
    came = answers.select(
        "account", "start_us", F.lit(True).alias("answers"), "request_id", F.lit(0.0).alias("audio_seconds"),
        F.coalesce(F.col("status").cast("int"), F.lit(NO_STATUS)).alias("status"), F.col("retry_header").cast("string").alias("retry_header"),
    )
    return asked.unionByName(came)


def quota_stream(usage: DataFrame, answers: DataFrame | None = None, delay: str = WATERMARK, **limits) -> DataFrame:
    """Admission verdict per request; answers with a failure make the account pause.

    State holds the admitted requests of one hour per account, and the pause.
    """
    rows = with_answers(usage, answers)
    schema = "account string, request_id bigint, verdict string, retry_after double"
    return _run(rows, "account", Admission({**DEFAULT_LIMITS, **limits}), schema, delay)


class UnitRules:
    """Lengths in frames: a unit may end at a pause from ``target`` on and must end at ``most``."""

    def __init__(self, frame_s: float, target_s: float, max_s: float, pause_s: float, overlap_s: float):
        frames = lambda s: int(np.ceil(round(s / frame_s, 9)))
        self.target, self.most, self.pause = frames(target_s), frames(max_s), frames(pause_s)
        self.overlap = int(overlap_s / frame_s)
        self.late, self.early = int(2.0 / frame_s), int(0.5 / frame_s)


def cut_run(energy: np.ndarray, speech: np.ndarray, core: int, rules: UnitRules, ended: bool) -> tuple[list, int, int]:
    """Units (start, end, core start, core end) of a run of frames without a jump, as frame numbers.

    ``core`` frames at the begin are context from the unit before. Also returns where the open rest begins and
    its context. With ``ended`` the rest is a unit too, if there is speech in it; silence alone is dropped.

    The last spoken frame before each place is known for the whole run, so a unit's end is looked up instead of
    fed frame by frame.
    """
    n, at, units = len(energy), 0, []
    spoken = np.maximum.accumulate(np.where(speech, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    while n - at >= rules.target:
        if spoken[at + rules.target - 1] < at:
            at, core = at + rules.target, 0
            continue
        ends = np.arange(at + rules.target, min(at + rules.most, n + 1))
        paused = np.flatnonzero(ends - 1 - spoken[ends - 1] >= rules.pause)
        if len(paused):
            end = int(ends[paused[0]])
            units.append((at, end, at + core, end))
            at, core = end, 0
        elif n - at >= rules.most:
            late = max(at, at + rules.most - rules.late)
            end = late + int(np.argmin(energy[late : at + rules.most - rules.early])) + 1
            units.append((at, min(end + rules.overlap, at + rules.most), at + core, end))
            at, core = end - rules.overlap, rules.overlap
        else:
            break
    if ended:
        if n - at > core and spoken[n - 1] >= at:
            units.append((at, n, at + core, n))
        at, core = n, 0
    return units, at, core


class BoundedUnits:
    """Open frames of a device: (start, frames of context, energies, speech). When no frame can follow, a run ends."""

    def __init__(self, rules: UnitRules, frame_us: int, jump_us: int):
        self.rules, self.frame_us, self.jump_us = rules, frame_us, jump_us

    def _units(self, start, core, energy, speech, ended):
        units, at, core = cut_run(energy, speech, core, self.rules, ended)
        state = (start + at * self.frame_us, core, energy[at:], speech[at:]) if at < len(energy) else None
        return state, [tuple(start + x * self.frame_us for x in u) for u in units]

    def fold(self, state, rows: list[tuple]) -> tuple:
        times, energy, speech = zip(*rows, strict=True)
        return self.extend(state, np.array(times, np.int64), np.array(energy, float), np.array(speech, bool))

    def extend(self, state, times: np.ndarray, energy: np.ndarray, speech: np.ndarray, now: int | None = None) -> tuple:
        """The new state, or None, and the units that end in these frames, which come in order of time, or by ``now``."""
        out, low = [], 0
        while low < len(times):
            start, core, e, s = state or (int(times[low]), 0, energy[:0], speech[:0])
            due = start + (len(e) + np.arange(len(times) - low)) * self.frame_us
            jumps = np.flatnonzero(np.abs(times[low:] - due) > self.jump_us)
            high = low + int(jumps[0]) if len(jumps) else len(times)
            e, s = (np.concatenate([x, y[low:high]]) if len(x) else y[low:high] for x, y in ((e, energy), (s, speech)))
            over = now is not None and start + len(e) * self.frame_us + self.jump_us <= now
            state, units = self._units(start, core, e, s, ended=over or high < len(times))
            out, low = out + units, high
        return state, out

    def open_until(self, state) -> int:
        return state[0] + len(state[2]) * self.frame_us + self.jump_us

    def finish(self, state) -> list[tuple]:
        return self._units(*state, ended=True)[1]


#: Shares of the devices, each one key of the state; their number stays the same for a checkpoint.
SHARES = 256
#: Frames of one device that came together: the least and the greatest time, and for each frame by how much it lies
#: behind its due time, its energy and whether it is speech, as the bytes of arrays.
PIECES = pa.schema([
    ("device_id", pa.string()), ("start_us", pa.int64()), ("last_us", pa.int64()),
    ("late", pa.binary()), ("energy", pa.binary()), ("speech", pa.binary()),
])
PIECE_COLUMNS = "device_id string, start_us bigint, last_us bigint, late binary, energy binary, speech binary"


def _joined(values: np.ndarray, lows: np.ndarray) -> pa.Array:
    """The bytes of ``values`` as one value from each of the places ``lows`` to the next."""
    ends = np.append(lows, len(values)).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(lows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _taken(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def to_pieces(device: np.ndarray, names: pa.Array, times, energy, speech, frame_us: int) -> pa.RecordBatch:
    """Frames as pieces, one for each device; ``device`` is the number of the name of each frame."""
    if (device[1:] < device[:-1]).any():
        order = np.argsort(device, kind="stable")
        device, times, energy, speech = device[order], times[order], energy[order], speech[order]
    lows = np.flatnonzero(np.append(True, device[1:] != device[:-1]))
    first = np.minimum.reduceat(times, lows)
    counts = np.diff(np.append(lows, len(device)))
    late = times - np.repeat(first, counts) - (np.arange(len(times)) - np.repeat(lows, counts)) * frame_us
    columns = [names.take(pa.array(device[lows])), pa.array(first), pa.array(np.maximum.reduceat(times, lows))]
    return pa.record_batch([*columns, _joined(late, lows), _joined(energy, lows), _joined(speech, lows)], schema=PIECES)


def from_pieces(pieces: pa.Table, frame_us: int) -> tuple:
    """(number of the device, names, times, energies, speech) of all frames of pieces."""
    names = pieces["device_id"].combine_chunks().dictionary_encode()
    energy, speech, late = _taken(pieces["energy"], np.float64), _taken(pieces["speech"], np.bool_), _taken(pieces["late"], np.int64)
    counts = np.array([len(x) for x in pieces["speech"].to_pylist()], np.int64)
    at = np.arange(len(energy)) - np.repeat(np.cumsum(counts) - counts, counts)
    times = np.repeat(pieces["start_us"].to_numpy(), counts) + at * frame_us + late
    return np.repeat(names.indices.to_numpy(), counts), names.dictionary, times, energy, speech


def pack_frames(frames: DataFrame, frame_us: int) -> DataFrame:
    """The frames of a device in each Arrow batch as one row. End marks have no device and pass as such."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch["device_id"].dictionary_encode("encode")
                energy = batch["energy"].cast(pa.float64()).fill_null(0.0).to_numpy()
                speech = batch["speech"].fill_null(False).to_numpy(zero_copy_only=False)
                yield to_pieces(names.indices.to_numpy(), names.dictionary, batch["start_us"].to_numpy(), energy, speech, frame_us)

    return frames.select("device_id", "start_us", "energy", "speech").mapInArrow(pack, PIECE_COLUMNS)


def pack_chunks(chunks: DataFrame, frame_us: int) -> DataFrame:
    """Chunks (device_id, start_us, energy, speech as arrays of frames without a jump) as pieces, row by row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                energy, speech = batch["energy"], batch["speech"]
                counts = np.diff(energy.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), counts)
                at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                times = batch["start_us"].to_numpy()[row] + at * frame_us
                loud, said = energy.flatten().fill_null(0.0).to_numpy(), speech.flatten().fill_null(False).to_numpy(zero_copy_only=False)
                yield to_pieces(row, batch["device_id"], times, loud, said, frame_us)

    # An end mark has no frames, so it gets one to be a piece of its own; empty chunks are none.
    mark = F.col("device_id").isNull()
    arrays = {
        "energy": F.when(mark, F.array(F.lit(0.0))).otherwise(F.col("energy")).cast("array<double>"),
        "speech": F.when(mark, F.array(F.lit(False))).otherwise(F.col("speech")),
    }
    rows = chunks.withColumns(arrays).where(F.size("energy") > 0)
    return rows.select("device_id", "start_us", "energy", "speech").mapInArrow(pack, PIECE_COLUMNS)


def _stored(pieces: pa.RecordBatch) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pieces.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pieces)
    return (sink.getvalue().to_pybytes(),)


def _read(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


class UnitShares(Waking):
    """Units of a share of the devices. Pieces wait until the watermark has passed their frames.

    Spark drops a piece when all of it is behind the watermark. Of another piece, frames at or before the watermark at
    which the share was last released are dropped here, as long as the share holds anything, so no run is broken.
    """

    OPEN = pa.schema([("device_id", pa.string()), ("start_us", pa.int64()), ("core", pa.int64()), ("energy", pa.binary()), ("speech", pa.binary())])
    columns = ["device_id", "start_us", "end_us", "core_start_us", "core_end_us"]

    def __init__(self, units: BoundedUnits):
        self.units = units

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pieces binary")
        self.kept = handle.getValueState("kept", "released_us bigint, open binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            pieces = pa.RecordBatch.from_pandas(pdf[PIECES.names], PIECES, preserve_index=False)
            self.waiting.appendList([_stored(pieces)])
            first = min(int(pdf["start_us"].min()), first or END_US)
        if first <= now:
            yield from self._advance(now)
        else:
            self._wake(first, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs() * 1000)

    def _opened(self) -> tuple[int | None, dict]:
        if not self.kept.exists():
            return None, {}
        released, stored = self.kept.get()
        rows = zip(*_read(bytes(stored)).to_pydict().values(), strict=True)
        return released, {d: (t, core, np.frombuffer(e, np.float64), np.frombuffer(s, np.bool_)) for d, t, core, e, s in rows}

    def _advance(self, now: int) -> Iterator[pd.DataFrame]:
        released, states = self._opened()
        held = [_read(bytes(stored)) for (stored,) in self.waiting.get()]
        out, ends, rest = [], [], None
        if held:
            device, names, times, energy, speech = from_pieces(pa.concat_tables(held), self.units.frame_us)
            ordered = (device[1:] > device[:-1]) | ((device[1:] == device[:-1]) & (times[1:] > times[:-1]))
            if not ordered.all():
                order = np.lexsort((speech, energy, times, device))
                device, times, energy, speech = device[order], times[order], energy[order], speech[order]
            if released is not None and (times <= released).any():
                on_time = times > released
                device, times, energy, speech = device[on_time], times[on_time], energy[on_time], speech[on_time]
            ripe = times <= now
            if not ripe.all():
                rest = to_pieces(device[~ripe], names, times[~ripe], energy[~ripe], speech[~ripe], self.units.frame_us)
                ends.append(int(times[~ripe].min()))
                device, times, energy, speech = device[ripe], times[ripe], energy[ripe], speech[ripe]
            cuts = np.flatnonzero(device[1:] != device[:-1]) + 1
            for low, high in zip([0, *cuts], [*cuts, len(device)], strict=True) if len(device) else ():
                name = names[int(device[low])].as_py()
                states[name], units = self.units.extend(states.get(name), times[low:high], energy[low:high], speech[low:high], now)
                out += [(name, *u) for u in units]
        for name, state in list(states.items()):
            if state is None or self.units.open_until(state) <= now:
                out += [(name, *u) for u in self.units.finish(state)] if state else []
                del states[name]
        self._keep(now, states, rest, bool(held))
        ends += [self.units.open_until(state) for state in states.values()]
        if ends:
            self._wake(min(ends), now)
        yield pd.DataFrame(out, columns=self.columns)

    def _keep(self, now: int, states: dict, rest: pa.RecordBatch | None, held: bool) -> None:
        if rest is not None:
            self.waiting.put([_stored(rest)])
        elif held:
            self.waiting.clear()
        if states or rest is not None:
            rows = [(d, t, core, e.tobytes(), s.tobytes()) for d, (t, core, e, s) in states.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(self.OPEN)
            self.kept.update((now, *_stored(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.OPEN, strict=True)], schema=self.OPEN))))
        elif self.kept.exists():
            self.kept.clear()


def bounded_units_stream(
    frames: DataFrame,
    frame_s: float = 0.5,
    target_s: float = 12.0,
    max_s: float = 24.0,
    pause_s: float = 0.6,
    jump_s: float = 0.025,
    overlap_s: float = 0.5,
    delay: str = WATERMARK,
    shares: int = SHARES,
) -> DataFrame:
    """Speech units of bounded length from frames (device_id, start_us, energy, speech), or from chunks of them.

    A chunk is a row whose energy and speech are arrays, of frames that follow each other from ``start_us`` on.

    A unit ends at a pause once it is long enough, at the quietest late frame when it reaches the maximum (the
    next unit then repeats a short context before its core), at a jump in time, and when no frame follows before
    the watermark. Each frame with speech is in the core of one unit. Silence alone is dropped.
    """
    us = lambda s: int(round(s * 1e6))
    rules = UnitRules(frame_s, target_s, max_s, pause_s, overlap_s)
    units = BoundedUnits(rules, us(frame_s), us(jump_s))
    pack = pack_chunks if isinstance(frames.schema["energy"].dataType, ArrayType) else pack_frames
    rows = timed(pack(frames, us(frame_s)), "last_us", delay)
    rows = rows.withColumn("share", F.pmod(F.xxhash64("device_id"), F.lit(shares)).cast("int"))
    schema = "device_id string, start_us bigint, end_us bigint, core_start_us bigint, core_end_us bigint"
    return rows.select("share", *PIECES.names, "event_time").groupBy("share").transformWithStateInPandas(
        statefulProcessor=UnitShares(units), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
