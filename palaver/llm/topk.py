"""Exact top-k inner products by pivot-table elimination.

A coordinate more gives all vectors one length, so that the largest inner product is the smallest
distance. Distances to the pivots are computed once and kept as a table. For a query and a candidate the
largest difference of their distances to a pivot is a lower bound of their distance. Candidates are
evaluated in the order of their bounds, until the next bound cannot reach the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.scratch import staged

PIVOTS = 16
#: Rows among which the pivots are chosen, and which give first thresholds. It bounds the driver's share.
SAMPLE_ROWS = 1024
#: Queries sent to the tasks at once; more queries are answered in more blocks.
BLOCK_QUERIES = 2048
_CANDIDATES = 2048
_CHUNK = 256
#: Sums below this are exact in doubles.
_EXACT = float(1 << 52)


@dataclass(frozen=True)
class Space:
    width: int
    longest: float  # largest squared length
    pivots: np.ndarray  # augmented coordinates
    sample_ids: np.ndarray
    sample: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors of one Arrow list column, filled with zeros up to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = column.flatten().to_numpy()
    return out


def _augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    v = vectors.astype(float)
    rest = np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
    return np.column_stack([v, rest])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], 1)


def _far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """Rows chosen one by one, each the farthest from those before it."""
    chosen = [0]
    gap = _distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def integer_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of each component, without rows that cannot take part.

    Rows with a null id, and vectors that are null or hold a null or non-finite component, are left out.
    """
    v = F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: x)
    finite = F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    good = F.col(f"`{embedding}`").isNotNull() & finite & F.col(f"`{vec_id}`").isNotNull()
    return vectors.where(good).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("v"),
    )


def build_space(ints: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> Space | None:
    """Pivots from a bounded sample, and the largest length over all rows; None for an empty table."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top = ints.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("longest")).first()
    if top.width is None:
        return None
    rows = ints.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).toArrow()
    sample = _matrix(rows.column("v"), top.width)
    points = _augmented(sample, top.longest)
    return Space(
        top.width, top.longest, _far_apart(points, pivots), rows.column("vec_id").to_numpy(), sample
    )


def pivot_table(ints: DataFrame, space: Space) -> DataFrame:
    """The vectors with their distance to each pivot and a number for each row, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _augmented(_matrix(batch.column("v"), space.width), space.longest)
            d = _distances(points, space.pivots)
            bounds = np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("v"),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(d.ravel())),
                ],
                names=["vec_id", "v", "d"],
            )

    table = ints.mapInArrow(run, "vec_id long, v array<long>, d array<double>")
    return staged(table.withColumn("row", F.monotonically_increasing_id()))


class _Best:
    """The k best (score, vec_id) of each query of a block."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.least = least.astype(float)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[q], scores])
        ids = np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(scores[order[-1]]))


def _first_thresholds(q: np.ndarray, ids: np.ndarray, space: Space, k: int) -> np.ndarray:
    """A score that at least k other rows reach, from the sample; minus infinity where it has too few."""
    exact = space.longest < _EXACT
    kind = float if exact else np.int64
    scores = (q.astype(kind) @ space.sample.astype(kind).T).astype(float)
    scores[ids[:, None] == space.sample_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(q), -np.inf)
    return np.partition(scores, -k, axis=1)[:, -k]


def _search(table: DataFrame, block, space: Space, k: int) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, q, d, least = shared.value
        exact = space.longest < _EXACT
        kind = float if exact else np.int64
        q = q.astype(kind)
        best = _Best(len(q), k, least)
        length = (q.astype(float) ** 2).sum(axis=1) + space.longest
        for batch in batches:
            for start in range(0, batch.num_rows, _CANDIDATES):
                part = batch.slice(start, _CANDIDATES)
                v = _matrix(part.column("v"), space.width).astype(kind)
                v_id = part.column("vec_id").to_numpy()
                v_d = part.column("d").flatten().to_numpy().reshape(len(v), -1)
                for low in range(0, len(q), 256):
                    high = min(low + 256, len(q))
                    bound = np.zeros((high - low, len(v)))
                    for p in range(v_d.shape[1]):
                        np.maximum(bound, np.abs(d[low:high, p, None] - v_d[None, :, p]), out=bound)
                    reach = (length[low:high, None] - bound * bound) / 2
                    reach += 1e-9 * (np.abs(reach) + length[low:high, None]) + 1e-6
                    reach[ids[low:high, None] == v_id[None, :]] = -np.inf
                    for n in range(low, high):
                        up = reach[n - low]
                        order = np.flatnonzero((up >= best.least[n]) & (up > -np.inf))
                        order = order[np.argsort(-up[order], kind="stable")]
                        for at in range(0, len(order), _CHUNK):
                            some = order[at : at + _CHUNK]
                            if up[some[0]] < best.least[n]:
                                break
                            scores = (v[some] @ q[n]).astype(np.int64)
                            good = scores >= best.least[n]
                            if good.any():
                                best.add(n, scores[good], v_id[some[good]])
        sizes = [len(x) for x in best.ids]
        owner = np.repeat(np.arange(len(q)), sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[owner]),
                pa.array(ids[owner]),
                pa.array(np.concatenate(best.ids)),
                pa.array(np.concatenate(best.scores)),
            ],
            names=["row", "query_id", "vec_id", "score"],
        )

    return table.select("vec_id", "v", "d").mapInArrow(run, "row long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    queries,
    *,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for each row where the condition
    ``queries`` (over ``vec_id``) holds, ties to the smaller id, fewer than k where there are fewer rows.

    Rows that carry the query's own id are its own and are left out; a repeated query row is answered for
    each of its rows. Rows with null ids and null or non-finite vectors take no part; shorter vectors are
    filled with zeros. Other columns are not read. Queries go to the tasks in blocks of ``block_queries``;
    every task keeps its k best per query, and those meet by query. Bounds are widened by rounding error, so
    the result is exact.
    """
    ints = integer_vectors(vectors, vec_id=vec_id, embedding=embedding)
    space = build_space(ints, pivots)
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if space is None:
        return nothing
    table = pivot_table(ints, space)
    asked = table.where(queries).select("row", "vec_id", "v", "d")
    count = asked.count()
    if not count:
        return nothing
    blocks = max(1, -(-count // block_queries))
    if blocks > 1:
        asked = staged(asked.withColumn("block", F.monotonically_increasing_id() % blocks))
    found = []
    for number in range(blocks):
        rows = (asked.where(F.col("block") == number) if blocks > 1 else asked).toArrow()
        q = _matrix(rows.column("v"), space.width)
        ids = rows.column("vec_id").to_numpy()
        # A query has 0 as its further coordinate: its distances then order by inner product alone.
        d = _distances(np.column_stack([q.astype(float), np.zeros(len(q))]), space.pivots)
        block = (rows.column("row").to_numpy(), ids, q, d, _first_thresholds(q, ids, space, k))
        part = _search(table, block, space, k)
        found.append(staged(part) if blocks > 1 else part)
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        union.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
