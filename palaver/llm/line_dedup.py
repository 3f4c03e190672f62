"""Fuzzy line deduplication by MinHash.

Lines are sets of character shingles. Their signatures are banded with high recall; all lines that meet in a
band are compared exactly unless they are linked already, and a distributed union-find keeps one line of each
component. Hashing and comparing runs over Arrow batches in tasks; SQL functions alone took 480 CPU seconds a
GB for the signatures. All else is in SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.graph import connected_components
from palaver.llm.ranks import bounded
from palaver.llm.scratch import staged
from palaver.llm.words import mix, steps

#: Two lines are alike from this Jaccard similarity of their shingle sets on.
THRESHOLD = 0.8
#: Least hashes by which a line is banded, four to a band. A pair at the threshold shares no band with
#: (1 - 0.41) ** 9, or 0.9 %. Each shingle belongs to two bins, so that few bins of a short line are empty.
BANDS, ROWS = 9, 4
BINS = BANDS * ROWS
#: Lines, and characters of lines, of one block of a larger band; all pairs of two blocks are compared at once.
BLOCK, BLOCK_CHARS = 256, 500_000
#: Characters of a shingle.
WIDTH = 8
#: Candidate lines up to which their ids are broadcast (16 bytes each); more are shuffled with the lines.
BROADCAST_LINES = 1_000_000
#: Bytes of lines hashed at once, and shingles whose incidence is held at once in a comparison.
_STEP_BYTES, _COLUMNS = 2_000_000, 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles at every character of all lines, and the line of each.

    The last shingles of a line end with it and are shorter: beyond the end there are zeros.
    """
    data = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    places = np.arange(len(data)) + owner * (WIDTH - 1)
    padded = np.zeros(len(data) + len(lines) * (WIDTH - 1) + WIDTH, np.uint64)
    padded[places] = data + np.uint64(1)
    out = np.zeros(len(padded) - WIDTH, np.uint64)
    for j in range(WIDTH):
        out *= _BASE
        out += padded[j : j + len(out)]
    return mix(out[places]), owner


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, n, lid, keys): band keys of each line; a band whose bins are all empty, in a very short line, is left out."""
    for batch in steps(batches, "line", _STEP_BYTES):
        hashes, owner = _hashes(batch.column("line").to_pylist())
        least = np.full(batch.num_rows * BINS, _NONE, np.uint64)
        for shift in (np.uint64(0), np.uint64(20)):
            np.minimum.at(least, owner * BINS + ((hashes >> shift) % np.uint64(BINS)).astype(np.int64), hashes)
        least = least.reshape(-1, BANDS, ROWS)
        key = np.zeros((batch.num_rows, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * _BASE + least[:, :, r])
        filled = (least != _NONE).any(axis=2)
        offsets = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[filled].view(np.int64)))
        own = ["id", "h", "n", "lid"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), keys], names=[*own, "keys"])


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows with a key that rows of equal id and text share; a null id sorts as 0, a null text is empty."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    number = F.col(f"`{doc_id}`").cast("bigint")
    return docs.select(
        F.coalesce(number, F.lit(0)).alias("id"),
        F.xxhash64(number.isNull(), body).alias("h"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("input"),
        body.alias("body"),
    )


def _lines(keyed: DataFrame) -> DataFrame:
    """Lines that are not blank, with their number and an id that equal lines share."""
    rows = keyed.select("id", "h", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    return rows.where(F.trim("line") != "").withColumn("lid", F.unhex(F.md5("line")))


def _sketched(lines: DataFrame) -> DataFrame:
    """Lines with their band keys instead of their text, written once: texts are not cut again to place them."""
    types = "id bigint, h bigint, n int, lid binary, keys array<bigint>"
    return staged(lines.select("id", "h", "n", "lid", "line").mapInArrow(_keys, types))


def _meetings(lines: DataFrame) -> DataFrame:
    """(key, lid, short, head, size): distinct lines of each band of two or more, and the least short id of them.

    Keys are written once, as one array a line. Bands of one distinct line go by their least and greatest short
    id, so equal lines need no shuffle of their own. The keys of the other bands are broadcast if they are few.
    """
    keyed = lines.withColumn("short", F.xxhash64("lid"))
    each = keyed.select(F.explode("keys").alias("key"), "short")
    shared = each.groupBy("key").agg(F.min("short").alias("head"), F.max("short").alias("last")).where("head != last")
    shared = staged(shared.select("key", "head"))
    rows = keyed.select("lid", "short", F.explode("keys").alias("key")).join(bounded(shared, BROADCAST_LINES), "key").distinct()
    sizes = F.count("*").alias("size")
    rows = staged(rows)
    return rows.join(rows.groupBy("key").agg(sizes), "key")


def _pairs(met: DataFrame) -> DataFrame:
    """Each line with the least head of its bands, if that is another one: a pair a line, however large a band is."""
    heads = met.groupBy("lid", "short").agg(F.min("head").alias("head")).where("head != short")
    named = met.where("head = short").select(F.col("lid").alias("x"), "head").distinct()
    return heads.join(named, "head").select("x", F.col("lid").alias("y"))


def _texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(lid, line): the wanted lines, each once."""
    small = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    found = lines.select("lid", "line").join(F.broadcast(wanted) if small else wanted, "lid")
    return staged(found.dropDuplicates(["lid"]))


def _counted(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of shingles as pairs of a line and the number of a hash, and the size of each set."""
    hashes, owner = _hashes(lines)
    distinct, number = np.unique(hashes, return_inverse=True)
    pairs = np.unique(owner * len(distinct) + number)
    owner, number = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
    return owner, number, np.bincount(owner, minlength=len(lines))


def _set_keys(lines: list[str]) -> np.ndarray:
    """Sorted distinct shingles of lines: the number of the line in 16 bits, then 48 bits of the hash."""
    hashes, owner = _hashes(lines)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(u, v) of the rows (x, y, a, b) whose lines ``a`` and ``b`` are alike."""
    for batch in steps(batches, "a", _STEP_BYTES):
        for first in range(0, batch.num_rows, 1 << 16):
            part = batch.slice(first, 1 << 16)
            n = part.num_rows
            left, right = (_set_keys(part.column(c).to_pylist()) for c in ("a", "b"))
            # Two sorted runs, which a stable sort merges; what both lines of a row have stands twice.
            both = np.sort(np.concatenate([left, right]), kind="stable")
            twice = both[1:][both[1:] == both[:-1]]
            size, common = (sum(np.bincount((k >> np.uint64(48)).astype(np.int64), minlength=n) for k in x) for x in ((left, right), (twice,)))
            found = part.filter(pa.array(common >= threshold * (size - common)))
            yield pa.RecordBatch.from_arrays([found.column("x"), found.column("y")], names=["u", "v"])


def _alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold, as edges; lines travel, not their sets."""
    left = texts.select(F.col("lid").alias("x"), F.col("line").alias("a"))
    right = texts.select(F.col("lid").alias("y"), F.col("line").alias("b"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b")
    return both.mapInArrow(lambda b: _compared(b, threshold), "u binary, v binary")


def _cells(met: DataFrame, pairs: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
    """(left, right): lines of bands that are not yet one component, in blocks, so that each pair meets.

    Bands of the same lines are taken once, and two lines that were compared already are left out. A band's lines
    grow by the number of its blocks.
    """
    two = met.where("size = 2").groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b"))
    seen = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    done = two.join(seen, ["a", "b"], "left_semi").select("key")
    inside = (
        met.join(done, "key", "left_anti")
        .select("key", "lid")
        .join(texts.select("lid", F.length("line").alias("n")), "lid")
        .join(components, F.col("lid") == F.col("node"), "left")
        .select("key", "lid", "n", F.coalesce("component", "lid").alias("component"))
    )
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_CHARS)).cast("int")
    open_ = (
        inside.groupBy("key")
        .agg(
            blocks.alias("blocks"),
            (F.min("component") != F.max("component")).alias("open"),
            F.bit_xor(F.xxhash64("lid")).alias("mark"),
            F.bit_xor(F.xxhash64("lid", F.lit(1))).alias("mark2"),
        )
        .where("open")
        .dropDuplicates(["mark", "mark2"])
        .select("key", "blocks")
    )
    placed = inside.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("lid", F.lit(11)), "blocks").cast("int"))
    # Block i is on the left of the cells (i, j) with j >= i, and on the right of the cells (j, i) with j < i.
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), (j >= F.col("block")).alias("left")
        ),
    )
    one = F.struct("component", "line")
    return (
        placed.select("key", "lid", "component", F.explode(every).alias("c"))
        .join(texts, "lid")
        .groupBy("key", "c.i", "c.j")
        .agg(
            F.collect_list(F.when(F.col("c.left"), one)).alias("left"),
            F.collect_list(F.when(~F.col("c.left"), one)).alias("right"),
        )
    )


def _cell_edges(left: list[dict], right: list[dict], threshold: float) -> set[tuple[bytes, bytes]]:
    """Pairs of components that alike lines join; ``right`` is empty where the left block is compared with itself."""
    lines = [x["line"] for x in left] + [x["line"] for x in right]
    owner, number, size = _counted(lines)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    common = np.zeros((len(lines), len(lines)), np.float32)
    last = int(number.max(initial=-1))
    for first in range(0, last + 1, _COLUMNS):
        a, b = np.searchsorted(number, [first, first + _COLUMNS])
        has = np.zeros((len(lines), min(_COLUMNS, last + 1 - first)), np.float32)
        has[owner[a:b], number[a:b] - first] = 1
        common += has @ has.T
    alike = common >= threshold * (size[:, None] + size[None, :] - common)
    components = [x["component"] for x in left] + [x["component"] for x in right]
    if right:
        alike[: len(left), : len(left)] = alike[len(left) :, len(left) :] = False
    # A walk over the alike lines: each line is reached once, so a cell has fewer edges than lines.
    out, open_ = set(), np.ones(len(lines), bool)
    for start in range(len(lines)):
        reached = [start] if open_[start] else []
        open_[start] = False
        while reached:
            i = reached.pop()
            for j in np.flatnonzero(alike[i] & open_):
                open_[j] = False
                reached.append(j)
                if components[i] != components[j]:
                    out.add((components[i], components[j]))
    return out


def _across(cells: DataFrame, threshold: float) -> DataFrame:
    """Edges between components that hold alike lines: every pair of a cell from different ones is compared.

    A cell returns a spanning forest, so edges do not grow with the pairs of lines.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _cell_edges(batch.column("left")[i].as_py(), batch.column("right")[i].as_py(), threshold)
                columns = [pa.array([e[k] for e in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    return cells.select("left", "right").mapInArrow(edges, "u binary, v binary").distinct()


def _components(met: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Components of alike lines: by heads of bands first, then by all pairs of bands that these leave apart."""
    pairs = staged(_pairs(met))
    texts = _texts(staged(met.select("lid").distinct()), lines)
    first = staged(connected_components(_alike(pairs, texts, threshold)))
    more = staged(_across(_cells(met, pairs, first, texts), threshold))
    if not more.limit(1).count():
        return first
    return connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def _marks(lines: DataFrame, components: DataFrame) -> DataFrame:
    """(id, h, removed): numbers of the lines of a document that go. Lines that are unlike all others are not looked at."""
    several = lines.groupBy("lid").agg(F.count("*").alias("times")).where("times > 1").select("lid")
    linked = components.withColumnRenamed("node", "lid")
    classes = several.join(linked, "lid", "full").select("lid", F.coalesce("component", "lid").alias("component"))
    rows = staged(lines.select("lid", "id", "h", "n").join(bounded(staged(classes), BROADCAST_LINES), "lid").drop("lid"))
    first = rows.groupBy("component").agg(F.min(F.struct("id", "n", "h")).alias("at")).select("at.id", "at.h", "at.n", F.lit(True).alias("stays"))
    every = rows.select("id", "h", "n", F.lit(False).alias("stays")).unionByName(first)
    lists = every.groupBy("id", "h").agg(F.collect_set("n").alias("n"), F.collect_set(F.when(F.col("stays"), F.col("n"))).alias("kept"))
    return lists.select("id", "h", F.array_except("n", "kept").alias("removed")).where(F.size("removed") > 0)


def dedupe_lines(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows with ``text`` reduced to the lines that stay, and ``n_lines``, ``n_removed``.

    Of all lines of a component the first stays, by ``doc_id``, then by its number in the text. Equal lines
    are one line. Blank lines are never compared and always stay. Null texts count as empty and stay null; null ids come as 0 in the order.
    Rows that agree in id and text are one document and come out alike. All other columns pass unchanged;
    input columns named ``n_lines`` or ``n_removed`` are replaced. An empty table gives no rows.
    """
    keyed = _keyed(docs, text, doc_id)
    lines = _lines(keyed)
    sketched = _sketched(lines)
    marks = _marks(sketched, _components(_meetings(sketched), lines, threshold))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    marks = staged(marks)
    # Counted by lines, as a document may lose many.
    small = (marks.agg(F.sum(F.size("removed"))).first()[0] or 0) <= BROADCAST_LINES
    out = keyed.select("id", "h", "input").join(F.broadcast(marks) if small else marks, ["id", "h"], "left")
    body = F.coalesce(F.col("input").getField(text).cast("string"), F.lit(""))
    parts = F.split(body, "\n")
    stays = _let(
        parts,
        lambda p: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("removed")), lambda i: F.get(p, i)), "\n"
        ),
    )
    new = F.when(F.col("input").getField(text).isNotNull(), F.when(F.col("removed").isNull(), body).otherwise(stays))
    return out.select(
        *(new.alias(c) if c == text else F.col("input").getField(c).alias(c) for c in columns),
        F.size(parts).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
    )
