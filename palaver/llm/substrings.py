"""Exact substring deduplication with prefix-partitioned suffix trees.

1. Each text is cut into runs of windows that share their least k-gram (the anchor). A run whose anchor
   occurs nowhere else holds no repeated window. Runs with equal words are copies and are settled at once.
2. The suffixes of the other runs become keys: a hash of the first words, then one as deep as a window. Each
   task first builds the tree of its own suffixes, so that equal suffixes leave it once.
3. Range partitioning by the keys cuts the suffixes at prefixes into parts of similar size: at the first
   words, and inside a frequent prefix at the whole window. Sorted, each part is a suffix tree in order; its
   internal nodes as deep as a window are the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.scratch import staged
from palaver.llm.tokenize import ragged
from palaver.llm.words import NOT_SPACE, SpanHashes, Words, mix, rolling, steps

#: Words of an anchor, and of the first level of the tree.
CHUNK = 7
#: Words of one repeated window.
WINDOW = 35
#: Suffixes of which one task builds a tree before it passes them on.
TREE_ROWS = 500_000
_SPREAD = WINDOW - CHUNK + 1
_KEYS = ["k0", "k1"]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the position of the leftmost least value among the next ``width``."""
    at, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = at[:-size], at[size:]
        at, size = np.where(values[a] <= values[b], a, b), 2 * size
    a, b = at[: len(values) - width + 1], at[width - size :]
    return np.where(values[a] <= values[b], a, b)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows with a key that equal rows share: id (null as 0) and a hash of text and null flag."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    number = F.col(f"`{doc_id}`").cast("bigint")
    return docs.select(
        F.coalesce(number, F.lit(0)).alias("id"),
        F.xxhash64(number.isNull(), body).alias("h"),
        number.alias("doc_id"),
        body.alias("text"),
    )


def _runs(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), NOT_SPACE)
            start = words.room(WINDOW)
            if not len(start):
                continue
            h = words.hashes()
            grams = rolling(h, CHUNK)
            anchor = _leftmost_least(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), _SPREAD)[start]
            owner = np.searchsorted(words.first, start, "right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            low = np.flatnonzero(new)
            high = np.append(low[1:], len(start)) - 1
            i0, i1, a, doc = start[low], start[high], anchor[low], owner[low]
            context = SpanHashes(h).of(i0, i1 + WINDOW)
            context = mix(context ^ mix(((a - i0) * 64 + (i1 - i0)).astype(np.uint64)))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[a].astype(np.int64)),
                    pa.array(context.astype(np.int64)),
                    batch.column("id").take(take),
                    batch.column("h").take(take),
                    pa.array((i0 - words.first[doc]).astype(np.int32)),
                    pa.array((i1 - words.first[doc]).astype(np.int32)),
                ],
                names=["anchor", "context", "id", "h", "low", "high"],
            )

    return keyed.select("id", "h", "text").mapInArrow(
        run, "anchor long, context long, id long, h long, low int, high int"
    )


def _settled(runs: DataFrame) -> DataFrame:
    """Spans of window starts: ``open`` false where the whole run occurs twice, true where a run must be
    looked at more closely because its anchor also occurs in other words.

    The sorted rows pass by once, with one row of memory, so one anchor may hold any share of them. At the
    ends of a partition the neighbour is unknown; the run there counts as open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        # Anchor and context of the row before ``tail``.
        past: tuple[int, int] | None = None
        done = False
        source = iter(batches)
        first = True
        while not done:
            batch = next(source, None)
            done = batch is None
            new = [] if done else [pa.Table.from_batches([batch])]
            rows = pa.concat_tables([*([] if tail is None else [tail]), *new])
            n = rows.num_rows
            if not n:
                tail = rows
                continue
            anchor = rows.column("anchor").to_numpy()
            context = rows.column("context").to_numpy()
            use = n if done else n - 1
            before_a, before_c = np.empty(n, bool), np.empty(n, bool)
            before_a[1:] = anchor[1:] == anchor[:-1]
            before_c[1:] = before_a[1:] & (context[1:] == context[:-1])
            before_a[0] = past is not None and anchor[0] == past[0]
            before_c[0] = past is not None and (anchor[0], context[0]) == past
            after_a, after_c = np.append(before_a[1:], False), np.append(before_c[1:], False)
            twice = before_c | after_c
            # A class is looked at by its first row if another class stands before it, else by its last.
            opens = (before_a & ~before_c) | (after_a & ~after_c)
            if first:
                opens[0] = True
                first = False
            if done:
                opens[-1] = True
            names = ["id", "h", "low", "high"]
            for mask, flag in ((twice[:use], False), (opens[:use], True)):
                at = np.flatnonzero(mask)
                if len(at):
                    out = rows.select(names).take(pa.array(at)).combine_chunks()
                    out = out.append_column("open", pa.array(np.full(len(at), flag)))
                    yield from out.to_batches()
            if use:
                past = (anchor[use - 1], context[use - 1])
            tail = rows.slice(use).combine_chunks()

    # The id lets a frequent run be split between partitions.
    order = ["anchor", "context", "id"]
    ranged = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "id long, h long, low int, high int, open boolean")


def deep_nodes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of each internal node of full depth, in sorted suffix keys (rows x chunks)."""
    common = (keys[1:] == keys[:-1]).all(axis=1)
    edge = np.diff(np.concatenate([[False], common, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _tree(keys: np.ndarray, *rest: np.ndarray):
    """Suffixes in key order; whether each lies under a deep node, and whether it is the node's first."""
    order = np.lexsort(keys.T[::-1])
    keys, rest = keys[order], [x[order] for x in rest]
    low, high = deep_nodes(keys)
    under, leaf = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    sizes = high - low + 1
    under[ragged(low, sizes)] = True
    leaf[ragged(low + 1, sizes - 1)] = False
    return keys, rest, under, leaf


_LEAVES = "id long, h long, pos int, done boolean, k0 long, k1 long"


def _suffixes(open_docs: DataFrame) -> DataFrame:
    """Suffixes at the starts of the open runs, each distinct one once with its key.

    ``done`` rows are repeats found inside the task. All but the first of equal suffixes get a key of their
    own instead, so that a frequent suffix is spread over the partitions.
    """

    def built(held):
        keys, ids, hs, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, (ids, hs, pos), under, leaf = _tree(keys, ids, hs, pos)
        lone = mix(mix(hs.view(np.uint64)) + pos.astype(np.uint64))
        keys = np.where(leaf[:, None], keys, lone[:, None])
        for row in range(0, len(ids), 50_000):
            part = slice(row, row + 50_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[part]),
                    pa.array(hs[part]),
                    pa.array(pos[part].astype(np.int32)),
                    pa.array(under[part]),
                    pa.array(keys[part, 0].astype(np.int64)),
                    pa.array(keys[part, 1].astype(np.int64)),
                ],
                names=["id", "h", "pos", "done", *_KEYS],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), NOT_SPACE)
            h = words.hashes()
            grams, windows = rolling(h, CHUNK), SpanHashes(h)
            spans = batch.column("spans")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            parts = spans.flatten()
            low, high = (parts.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            sizes = high - low + 1
            doc = np.repeat(owner, sizes)
            pos = ragged(low, sizes)
            at = words.first[doc] + pos
            keys = np.stack([grams[at], windows.of(at, at + WINDOW)], 1)
            held.append((keys, batch.column("id").to_numpy()[doc], batch.column("h").to_numpy()[doc], pos))
            rows += len(pos)
            if rows >= TREE_ROWS:
                yield from built(held)
                held, rows = [], 0
        if rows:
            yield from built(held)

    return open_docs.mapInArrow(run, _LEAVES)


def _repeated_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves under a deep node of the tree over all tasks. Equal keys lie in one range partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, past = None, None
        source, done = iter(batches), False
        while not done:
            batch = next(source, None)
            done = batch is None
            rows = pa.concat_tables(
                [*([] if tail is None else [tail]), *([] if done else [pa.Table.from_batches([batch])])]
            )
            n = rows.num_rows
            if not n:
                tail = rows
                continue
            keys = np.stack([rows.column(k).to_numpy() for k in _KEYS], 1)
            use = n if done else n - 1
            under = rows.column("done").to_numpy().copy()
            low, high = deep_nodes(keys)
            under[ragged(low, high - low + 1)] = True
            if past is not None and (keys[0] == past).all():
                under[0] = True
            at = np.flatnonzero(under[:use])
            if len(at):
                yield from rows.select(["id", "h", "pos"]).take(pa.array(at)).combine_chunks().to_batches()
            if use:
                past = keys[use - 1]
            tail = rows.slice(use).combine_chunks()

    ranged = leaves.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    return ranged.mapInArrow(run, "id long, h long, pos int")


def repeated_starts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Starts of repeated windows as spans: (id, h, low, high), where (id, h) is the key of equal rows.

    Spans of one key may overlap. Two equal rows are two texts: each repeats the other.
    """
    keyed = _keyed(docs, text, doc_id)
    marks = staged(_settled(_runs(keyed)))
    spans = marks.where("open").groupBy("id", "h").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    # All columns go on, so that this join and the one of ``remove_repeats`` share one shuffle of the texts.
    open_docs = keyed.join(spans, ["id", "h"]).select("id", "h", "doc_id", "text", "spans")
    single = F.struct(F.col("pos").alias("low"), F.col("pos").alias("high"))
    found = _repeated_leaves(_suffixes(open_docs))
    return (
        marks.where(~F.col("open"))
        .select("id", "h", F.struct("low", "high").alias("span"))
        .unionByName(found.select("id", "h", single.alias("span")))
        .groupBy("id", "h")
        .agg(F.collect_set("span").alias("spans"))
    )


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word that a repeated window of 35 words covers is removed.

    Words are runs of anything but ASCII white space; ``kept`` joins the others by one blank. A window is
    repeated if its words also start anywhere else in the table, the same text included. Windows are judged
    on the input. A null text has no words. Texts shorter than a window stay whole. Rows with null ids and
    repeated rows are texts like any other, so a repeated row of 35 words or more loses them all. Other columns
    are not read. An empty table gives no rows. Windows are compared by 128 bits of hashes.
    """
    keyed = _keyed(docs, text, doc_id)
    spans = repeated_starts(docs, text=text, doc_id=doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), NOT_SPACE)
            spans = batch.column("spans")
            sizes = np.zeros(batch.num_rows, np.int64)
            full = spans.is_valid().to_numpy(zero_copy_only=False)
            lengths = np.diff(spans.offsets.to_numpy())
            sizes[full] = lengths[full]
            parts = spans.flatten()
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            low, high = (parts.field(i).to_numpy().astype(np.int64) + words.first[owner] for i in (0, 1))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, high + WINDOW, -1)
            kept = np.cumsum(change[:-1]) == 0
            n_kept = np.bincount(words.owners()[kept], minlength=batch.num_rows) if len(words) else sizes * 0
            at = np.flatnonzero(kept)
            size = words.ends[at] - words.starts[at] + 1
            ends = np.cumsum(size)
            body = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            inside = np.ones(len(body), bool)
            inside[ends - 1] = False
            body[inside] = words.data[ragged(words.starts[at], size - 1)]
            last = np.cumsum(n_kept)
            stop = np.concatenate([[0], ends])[last]
            start = np.concatenate([[0], stop[:-1]])
            joined = body.tobytes()
            texts = [joined[a : max(a, b - 1)].decode() for a, b in zip(start, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.counts, pa.int64()),
                    pa.array(words.counts - n_kept, pa.int64()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = keyed.join(spans, ["id", "h"], "left").select("id", "h", "doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
