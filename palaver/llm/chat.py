"""Chat formatting: a finite-state machine over roles checks the turn order, a template writes the turns.

The template is declared, not coded: markers around the turns of each role, which texts count for the loss, and
the transitions between states. A turn becomes text segments with a loss flag each. Control strings inside texts
are escaped so that they can be taken back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.ranks import bounded, in_chunks
from palaver.llm.scratch import staged

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """Markers around the text of a role, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers by role, the markers of any other role, and the state machine.

    ``other`` stands around the name of a role that ``turns`` does not have (first two) and its text (last two).
    ``steps`` maps (state, role) to the next state. What is not in it is a violation: the turn is written all the
    same, and the machine goes on as if it had started with this turn. A conversation may end in ``final`` only.
    Control strings are ``controls``; each begins with a character that stands nowhere else in any of them, no
    one is the beginning of another, and every marker begins with one.
    """

    controls: tuple[str, ...]
    turns: dict[str, Turn]
    other: tuple[str, str, str]
    steps: dict[tuple[str, str], str]
    start: str = "start"
    final: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls}
        for c in self.controls:
            if any(x in heads or x == ESCAPE for x in c[1:]) or c[0] == ESCAPE or len(c) < 2:
                raise ValueError(f"control string {c!r} repeats a first character")
            if any(c != d and d.startswith(c) for d in self.controls):
                raise ValueError(f"control string {c!r} begins another one")
        marks = [*self.other, *(m for t in self.turns.values() for m in (t.before, t.after))]
        if not all(m.startswith(self.controls) for m in marks):
            raise ValueError("a marker does not begin with a control string")
        if len({t.before for t in self.turns.values()} | {self.other[0]}) <= len(self.turns):
            raise ValueError("two roles begin alike")

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.final, *(s for s, _ in self.steps), *self.steps.values()})

    def _parts(self) -> tuple[str, str, str]:
        heads = "".join(sorted({c[0] for c in self.controls}))
        tails = "|".join(re.escape(c[1:]) for c in self.controls)
        return f"([{re.escape(heads)}])", re.escape(ESCAPE), f"({tails})"

    def escape(self, text: Column) -> Column:
        """``text`` with one more escape character inside each control string, also inside escaped ones."""
        head, mark, tail = self._parts()
        return F.regexp_replace(text, f"{head}({mark}*){tail}", r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        """``text`` as it was before ``escape``."""
        head, mark, tail = self._parts()
        return F.regexp_replace(text, f"{head}({mark}*){mark}{tail}", "$1$2$3")

    def segments(self, role: Column, text: Column) -> Column:
        """Segments of one turn: marker, text, marker; a role without markers of its own is written out."""

        def piece(x: Column, loss: bool) -> Column:
            return F.struct(x.alias("text"), F.lit(loss).alias("loss"))

        head, middle, tail = self.other
        name = F.concat(F.lit(head), self.escape(role), F.lit(middle))
        out = F.array(piece(name, False), piece(self.escape(text), False), piece(F.lit(tail), False))
        for r, t in self.turns.items():
            own = F.array(piece(F.lit(t.before), False), piece(self.escape(text), t.loss), piece(F.lit(t.after), False))
            out = F.when(role == r, own).otherwise(out)
        return out

    def read(self, written: Column) -> Column:
        """(role, text) of one written turn, from nothing but its text."""

        def inner(before: str, after: str) -> Column:
            return F.substring(written, F.lit(len(before) + 1), F.length(written) - (len(before) + len(after)))

        head, middle, tail = self.other
        rest = inner(head, tail)
        cut = F.instr(rest, F.lit(middle))
        out = F.struct(
            self.unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            self.unescape(F.substring(rest, cut + len(middle), F.length(rest))).alias("text"),
        )
        for r, t in self.turns.items():
            own = F.struct(F.lit(r).alias("role"), self.unescape(inner(t.before, t.after)).alias("text"))
            out = F.when(F.startswith(written, F.lit(t.before)), own).otherwise(out)
        return out


#: Bracketed instructions, a system turn at most once and first, then user and assistant by turns.
INSTRUCT = Template(
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/SAYS]"),
    turns={
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST] ", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=("[ROLE]", "[SAYS]", "[/SAYS]"),
    steps={
        ("start", "system"): "told",
        ("start", "user"): "asked",
        ("told", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    final=frozenset({"answered"}),
)

_KEYS = ["conv_id", "turn", "role", "text"]


def _walk(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Adds ``allowed`` and ``after``: whether a turn is allowed, and the state after it, for each state in which
    the conversation may have come into this chunk. A role is looked up once for each run of states."""
    names = template.states
    number = {s: i for i, s in enumerate(names)}
    wrong = len(names)
    fresh = {r: number[s] for (at, r), s in template.steps.items() if at == template.start}
    moves: dict[str, list[tuple[int, bool]]] = {}

    def move(role: str) -> list[tuple[int, bool]]:
        if role not in moves:
            to = [template.steps.get((s, role)) for s in names]
            again = fresh.get(role, wrong)
            moves[role] = [(number[t], True) if t is not None else (again, False) for t in to] + [(again, role in fresh)]
        return moves[role]

    here, states = object(), []
    known = {r for _, r in template.steps}
    for batch in batches:
        after, allowed = [], []
        for conv, role in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), strict=True):
            if conv != here:
                here, states = conv, list(range(wrong + 1))
            step = move(role if role in known else "")
            allowed.append([step[s][1] for s in states])
            states = [step[s][0] for s in states]
            after.append(states)
        columns = [*batch.columns, pa.array(after, pa.list_(pa.int32())), pa.array(allowed, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "after", "allowed"])


def _entries(rows: DataFrame, start: int) -> DataFrame:
    """(conv, chunk, entry): the state in which a conversation comes into each of its chunks.

    Only conversations of several chunks are in it, with one short row a chunk, so their number is below twice
    that of the chunks.
    """
    last = rows.groupBy("conv_id", "chunk").agg(F.max_by("after", "row").alias("after"))
    many = last.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"))
    several = last.join(bounded(staged(many)), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, out = start, []
        for after in pdf["after"]:
            out.append(state)
            state = int(after[state])
        return pdf[["conv_id", "chunk"]].assign(entry=out)

    kind = rows.schema["conv_id"].dataType.simpleString()
    found = several.groupBy("conv_id").applyInPandas(follow, f"conv_id {kind}, chunk bigint, entry int")
    return staged(found.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "entry"))


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Turns as (conv_id, turn, role, n, segments, allowed, state): ``segments`` is a list of (text, loss).

    Rows of a conversation are ordered by turn, then by role and text; ``n`` rises in this order. ``allowed`` is
    false where the state machine has no step, ``state`` is the one after the turn. Rows are sorted in range
    partitions, and a conversation may lie in many of them: each row carries the outcome for every state in
    which the conversation may have come in, and the true one is found from one row a partition.

    Null texts and roles are empty; null ids are one conversation; a null turn comes first. Repeated rows are
    turns of their own. Roles that the template does not know are written out with their name. Texts are
    never cut. Other columns take no part. An empty table gives no rows.
    """
    empty = F.lit("")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    rows = in_chunks(rows, _KEYS)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", after array<int>, allowed array<boolean>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, template)

    names = template.states
    start = names.index(template.start)
    walked = staged(rows.mapInArrow(walk, schema))
    entries = bounded(_entries(walked, start))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    come = F.coalesce("entry", F.lit(start)) + 1
    known = F.array(*(F.lit(s) for s in names))
    return walked.join(entries, same, "left").select(
        "conv_id",
        "turn",
        "role",
        F.col("row").alias("n"),
        template.segments(F.col("role"), F.col("text")).alias("segments"),
        F.element_at("allowed", come).alias("allowed"),
        F.get(known, F.element_at("after", come)).alias("state"),
    )


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, n, role, text, loss_text, written, allowed, state), from the written segments alone.

    ``loss_text`` is what stands in segments under the loss, without escapes.
    """
    written = F.array_join(F.transform("segments", lambda s: s.text), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), "")
    rows = formatted.select("conv_id", "n", "allowed", "state", written.alias("written"), loss.alias("loss"))
    turn = template.read(F.col("written"))
    return rows.select("conv_id", "n", turn.alias("t"), template.unescape(F.col("loss")).alias("loss_text"), "written", "allowed", "state").select(
        "conv_id", "n", "t.role", "t.text", "loss_text", "written", "allowed", "state"
    )


def digests(rows: DataFrame, key: str, order: str, hashed: dict[str, str], sums: list[str], last: list[str]) -> DataFrame:
    """One row for each key: its rows, SHA-256 of columns one after another in order, sums and last values.

    A digest needs all its bytes in order, so the rows of a key pass through one task, one batch at a time: the
    task keeps a running digest, never the rows. Rows are sorted outside Python and may spill.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n bigint, " + ", ".join([f"{n} string" for n in hashed] + [f"{s} bigint" for s in sums] + [f"{c} string" for c in last])
    target = rows.select(key, order, *hashed.values(), *sums, *last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = None
        now = None

        def closed() -> pa.RecordBatch:
            k, n, marks, totals, ends = now
            values = [k, n, *(m.hexdigest() for m in marks), *totals, *ends]
            types = [field.type, pa.int64(), *[pa.string()] * len(marks), *[pa.int64()] * len(totals), *[pa.string()] * len(ends)]
            arrays = [pa.array([v], t) for v, t in zip(values, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[key, "n", *hashed, *sums, *last])

        for batch in batches:
            field = batch.schema.field(key)
            keys = batch.column(key).to_pylist()
            texts = [batch.column(c) for c in hashed.values()]
            numbers = [batch.column(s).to_pylist() for s in sums]
            ends = [batch.column(c) for c in last]
            for i, k in enumerate(keys):
                if now is None or k != now[0]:
                    if now is not None:
                        yield closed()
                    now = [k, 0, [hashlib.sha256() for _ in hashed], [0] * len(sums), [None] * len(last)]
                now[1] += 1
                for mark, column in zip(now[2], texts, strict=True):
                    mark.update(column[i].as_py().encode())
                for j, values in enumerate(numbers):
                    now[3][j] += values[i]
                now[4] = [e[i].as_py() for e in ends]
        if now is not None:
            yield closed()

    return target.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)

