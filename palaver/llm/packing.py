"""Packing of documents into token windows by order-preserving dynamic programming.

Documents keep their order. A window ends at a document, at a sentence, or, where a sentence is longer
than ``stride`` tokens, inside it. Each cut has a price: padding, plus a penalty for cutting a document.
The cheapest set of cuts follows from a sliding minimum over the possible starts of a window; windows
whose length is a power of two need no padding and are looked up directly.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palaver.llm.tokenize import WordEncoder
from palaver.llm.words import steps

#: Text that one plan of cuts spans. Windows do not cross it, which costs one short window at most.
BLOCK_BYTES = 4_000_000
END_ID = 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> tuple[WordEncoder, np.ndarray]:
    """The encoder of a worker, and a flag for each id that ends a sentence."""
    encoder = WordEncoder(vocabulary)
    words = encoder.tokenizer.get_vocab(with_added_tokens=True)
    stops = np.zeros(max(words.values()) + 2, bool)
    for word, number in words.items():
        stops[number] = word.removesuffix("</w>").endswith((".", "!", "?", "ãĢĤ"))
    return encoder, stops


def cheapest_cuts(
    places: np.ndarray, penalty: np.ndarray, window: int, window_cost: int
) -> np.ndarray:
    """Numbers of the places at which windows end.

    ``places`` ascend from 0 to the number of tokens, no two further apart than ``window``. A window of
    n tokens costs ``window_cost`` plus ``window - n``, or no padding where n is a power of two, plus the
    penalty of its end.
    """
    n = len(places)
    if n < 2:
        return np.zeros(0, np.int64)
    exact_at, exact_from = [], []
    size = 1
    while size < window:
        j = np.searchsorted(places, places - size)
        hit = np.flatnonzero(places[j] == places - size)
        exact_at.append(hit)
        exact_from.append(j[hit])
        size *= 2
    at, source = np.concatenate(exact_at), np.concatenate(exact_from)
    order = np.argsort(at, kind="stable")
    at, source = at[order].tolist(), source[order].tolist()
    at.append(n)
    pos, fine = places.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    k = 0
    for i in range(1, n):
        here = pos[i]
        low = here - window
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, j = queue[0]
        value += window - here
        while at[k] == i:
            if best[source[k]] < value:
                j = source[k]
                value = best[j]
            k += 1
        value += window_cost + fine[i]
        best[i], back[i] = value, j
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    cuts = []
    i = n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return np.array(cuts[::-1], np.int64)


def possible_ends(
    ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, stride: int, costs: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and their penalties: documents 0, sentences and gaps ``costs``."""
    sentence = np.flatnonzero(stops[ids]) + 1
    soft = np.union1d(np.union1d(sentence, ends), [0])
    gap = np.diff(soft)
    wide = np.flatnonzero(gap > stride)
    inner = (gap[wide] - 1) // stride
    forced = np.repeat(soft[wide], inner) + stride * (
        np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    )
    places = np.concatenate([soft, forced])
    penalty = np.concatenate([np.full(len(soft), costs[0]), np.full(len(forced), costs[1])])
    order = np.argsort(places, kind="stable")
    places, penalty = places[order], penalty[order]
    penalty[np.isin(places, ends)] = 0
    return places, penalty


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = 2048,
    sentence_penalty: int = 4,
    inner_penalty: int = 16,
    window_cost: int = 32,
    stride: int = 256,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pieces of windows: each token id of each document lies in exactly one piece.

    A document is its ids by ``vocabulary`` and then id 1; a null text counts as empty, so it is the id 1
    alone. ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers. Rows with a null or
    repeated ``doc_id`` are documents of their own. Other columns are not read, so their names do not
    matter; no rows give no pieces. Work runs where the rows lie, block by block and without a shuffle, and
    memory is bounded by ``block_bytes`` or the longest text. The number of a window holds its
    partition, so a task that runs again gives the same numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stops = _encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        for batch in steps(batches, "text", block_bytes):
            ids, counts = encoder.encode(batch.column("text"))
            counts = counts + 1
            ends = np.cumsum(counts)
            stream = np.full(int(ends[-1]), END_ID, np.uint32)
            body = np.ones(len(stream), bool)
            body[ends - 1] = False
            stream[body] = ids
            places, penalty = possible_ends(
                stream, ends, stops, stride, (sentence_penalty, inner_penalty)
            )
            cuts = places[cheapest_cuts(places, penalty, window, window_cost)]
            starts = np.concatenate([[0], cuts[:-1]])
            begin = np.union1d(starts, ends - counts)
            length = np.diff(np.append(begin, len(stream)))
            doc = np.searchsorted(ends, begin, "right")
            which = np.searchsorted(starts, begin, "right") - 1
            bounds = pa.py_buffer((4 * np.append(begin, len(stream))).astype(np.int64))
            pieces = pa.Array.from_buffers(
                pa.large_binary(), len(begin), [None, bounds, pa.py_buffer(stream.astype("<u4"))]
            )
            columns = [
                batch.column("doc_id").take(pa.array(doc)),
                begin - (ends - counts)[doc],
                length,
                pieces.cast(pa.binary()),
                counts[doc],
                sequence + which,
                begin - starts[which],
            ]
            out = pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts)
            for row in range(0, out.num_rows, 4096):
                yield out.slice(row, 4096)
        # A worker may go on to other work, which needs the memory.
        encoder.forget()

    source = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    return source.mapInArrow(run, PIECES)
