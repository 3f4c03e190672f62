"""Toxicity categories by a classifier chain.

Categories are predicted one after another. Each has a linear model over words and shape figures of the
text and over the probabilities of the categories before it. In training those probabilities are
out-of-fold: each row's come from models that have not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.scratch import staged
from palaver.llm.words import Words, byte_table, steps

#: Labelled rows that a model is fitted on at most, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: Words that a model weighs, chosen by their association with any category.
FEATURES = 512
FOLDS = 3
_LEAST_COUNT = 5
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
_WORD_BYTES = byte_table(
    "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
)
SHAPES = ("words", "distinct", "length", "upper", "digits", "signs", "lines")


def _shape(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Figures of each text: numbers of words and lines, and shares of kinds of characters."""
    n = len(words.counts)
    data, at = words.data, words.offsets

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)

    owner = words.owners()
    _, first = np.unique(hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(owner[first], minlength=n) if len(owner) else np.zeros(n)
    inside = np.bincount(owner, weights=words.ends - words.starts, minlength=n) if len(owner) else np.zeros(n)
    count = np.maximum(words.counts, 1)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    sign = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | (data > 122) & (data < 127)
    return np.column_stack(
        [
            np.log1p(words.counts),
            distinct / count,
            inside / count,
            share(upper),
            share(digit),
            share(sign),
            share(data == 10),
        ]
    )


@dataclass(frozen=True)
class Linear:
    """``weights`` for words, shapes and earlier categories in this order, and a constant."""

    weights: np.ndarray
    constant: float


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    words: np.ndarray  # sorted hashes
    centre: np.ndarray
    spread: np.ndarray
    models: tuple[Linear, ...]
    thresholds: tuple[float, ...]


class _Rows:
    """Sparse words and dense figures of rows, with the two products that a linear model needs."""

    def __init__(self, row: np.ndarray, word: np.ndarray, dense: np.ndarray, n_words: int):
        self.row, self.word, self.dense, self.n_words = row, word, dense, n_words

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.row, weights=w[self.word], minlength=len(self.dense))
        return out + self.dense @ w[self.n_words :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.word, weights=r[self.row], minlength=self.n_words), self.dense.T @ r])

    def with_columns(self, more: np.ndarray) -> _Rows:
        return _Rows(self.row, self.word, np.column_stack([self.dense, more]), self.n_words)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _fit(rows: _Rows, y: np.ndarray, use: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> Linear:
    """Logistic regression on the rows ``use`` by accelerated gradient steps."""
    n = float(use.sum())
    size = rows.n_words + rows.dense.shape[1]
    rate = (y[use].sum() + 0.5) / (n + 1)
    if n == 0:
        return Linear(np.zeros(size), float(_logit(np.array(0.0))))
    mask = use.astype(float)
    v = np.ones(size) / np.sqrt(size)
    for _ in range(15):
        v = rows.back(rows.times(v) * mask)
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / (0.25 * (top + n) + ridge)
    w, b = np.zeros(size), float(_logit(np.array(rate)))
    seen_w, seen_b = w, b
    for t in range(rounds):
        fast = t / (t + 3)
        look_w, look_b = w + fast * (w - seen_w), b + fast * (b - seen_b)
        error = (_sigmoid(rows.times(look_w) + look_b) - y) * mask
        seen_w, seen_b = w, b
        w = look_w - step * (rows.back(error) + ridge * look_w)
        b = look_b - step * error.sum()
    return Linear(w, b)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which the F1 of the out-of-fold predictions is highest."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    last = np.append(p[order][1:] != p[order][:-1], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][i + 1] if i + 1 < len(y) else 0.0
    return float((p[order][i] + below) / 2)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of each distinct word of a text, and the shape figures."""
    words = Words(batch.column("text"), _WORD_BYTES, lower=True)
    h = words.hashes()
    owner = words.owners()
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new].astype(np.int64), _shape(words, words.hashes())


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
    features: int = FEATURES,
    folds: int = FOLDS,
) -> Chain:
    """A chain over ``categories`` in their order; each is a condition over the columns of ``labels``.

    Rows with a null id or a null condition are not learned from; of repeated ids one row stays, and a
    category holds if any of its labels says so. At most ``sample_rows`` labelled documents are used, those
    with the least hashes of their ids; this bounds the broadcast and what the driver holds. Without
    labelled rows every probability is next to 0.
    """
    names = list(categories)
    marked = labels.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), *(c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())))
    sample = (
        marked.dropna()
        .groupBy("id")
        .agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    ys = [f"y{i}" for i in range(len(names))]
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            owner, h, shape = _features(batch)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            width = np.arange(0, shape.size + 1, shape.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *(batch.column(y) for y in ys),
                    pa.ListArray.from_arrays(pa.array(width), pa.array(shape.ravel())),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(h)),
                ],
                names=["id", *ys, "shape", "words"],
            )

    schema = f"id long, {', '.join(f'{y} int' for y in ys)}, shape array<double>, words array<long>"
    rows = staged(
        source.join(F.broadcast(sample), "id").select("id", "text", *ys).mapInArrow(run, schema).dropDuplicates(["id"])
    )
    chosen = _chosen_words(rows, ys, features)
    kept = F.array(*(F.lit(int(x)) for x in chosen)) if len(chosen) else F.array().cast("array<bigint>")
    table = rows.select("id", *ys, "shape", F.array_intersect("words", kept).alias("words")).orderBy("id").toArrow()
    return _fit_rows(table, names, ys, chosen, folds)


def _chosen_words(rows: DataFrame, ys: list[str], features: int) -> np.ndarray:
    """Hashes of the words most associated with any category, by the likelihood ratio."""
    total = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys)).first()
    counts = (
        rows.select(*ys, F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys))
        .where(F.col("n") >= _LEAST_COUNT)
    )
    if not total.n:
        return np.zeros(0, np.int64)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    def ratio(y: str):
        share = (total[y] + 0.5) / (total.n + 1)
        hit, miss = F.col(y).cast("double"), (F.col("n") - F.col(y)).cast("double")
        return part(hit, F.col("n") * share) + part(miss, F.col("n") * (1 - share))

    score = F.greatest(*(ratio(y) for y in ys)) if len(ys) > 1 else ratio(ys[0])
    best = counts.select("word", score.alias("score")).orderBy(F.desc("score"), "word").limit(features)
    return np.sort(np.array([r.word for r in best.collect()], np.int64))


def _fit_rows(table: pa.Table, names: list[str], ys: list[str], chosen: np.ndarray, folds: int) -> Chain:
    n = table.num_rows
    words = table.column("words").combine_chunks()
    sizes = np.diff(words.offsets.to_numpy()) if n else np.zeros(0, np.int64)
    word = np.searchsorted(chosen, words.flatten().to_numpy()) if n else np.zeros(0, np.int64)
    shape = table.column("shape").combine_chunks().flatten().to_numpy().reshape(n, len(SHAPES)) if n else np.zeros((0, len(SHAPES)))
    centre = shape.mean(axis=0) if n else np.zeros(len(SHAPES))
    spread = shape.std(axis=0) + 1e-9 if n else np.ones(len(SHAPES))
    rows = _Rows(np.repeat(np.arange(n), sizes), word, (shape - centre) / spread, len(chosen))
    fold = np.arange(n) * 2654435761 % 4294967296 % folds
    models, thresholds = [], []
    for y in ys:
        truth = table.column(y).to_numpy().astype(float) if n else np.zeros(0)
        apart = np.zeros(n)
        for k in range(folds):
            m = _fit(rows, truth, fold != k)
            apart[fold == k] = _sigmoid(rows.times(m.weights) + m.constant)[fold == k]
        models.append(_fit(rows, truth, np.ones(n, bool)))
        thresholds.append(_best_threshold(apart, truth))
        # Later categories learn from the out-of-fold probabilities.
        rows = rows.with_columns(_logit(apart)[:, None])
    return Chain(tuple(names), chosen, centre, spread, tuple(models), tuple(thresholds))


def predict(docs: DataFrame, chain: Chain, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``p_<category>`` and ``is_<category>`` for each category.

    A category holds from the threshold on that was best out-of-fold. Null texts count as empty; rows with
    null or repeated ids are scored like any other. Input columns with a new name are replaced.
    """
    new = [f"p_{c}" for c in chain.categories]
    flags = [f"is_{c}" for c in chain.categories]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new and c not in flags]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = shared.value
        for batch in steps(batches, "text"):
            owner, h, shape = _features(batch)
            if len(model.words):
                at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                hit = model.words[at] == h
            else:
                at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            rows = _Rows(owner[hit], at[hit], (shape - model.centre) / model.spread, len(model.words))
            found = []
            for m in model.models:
                p = _sigmoid(rows.times(m.weights) + m.constant)
                found.append(pa.array(p))
                rows = rows.with_columns(_logit(p)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *found], names=["kept", *new])

    source = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    schema = source.select("kept", *(F.lit(0.0).alias(c) for c in new)).schema
    out = source.mapInArrow(run, schema)
    return out.select(
        *(F.col("kept").getField(c).alias(c) for c in keep),
        *new,
        *((F.col(p) >= t).alias(f) for p, f, t in zip(new, flags, chain.thresholds, strict=True)),
    )
