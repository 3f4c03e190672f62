"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a public vocabulary and its single bytes. A language is a probability for each
piece; the probability of a word is the sum over all ways to cut it into pieces, by a forward pass.
Training is expectation maximisation over a table of word counts per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.scratch import staged
from palaver.llm.tokenize import ragged
from palaver.llm.words import NOT_SPACE, Words, steps

#: A run without white space is cut into words of so many bytes; segmentations do not cross the cut.
WORD_BYTES = 48
#: Each byte of a piece carries this factor, so that products stay inside the range of doubles.
SCALE = 1e4
STEP_BYTES = 2_500_000
UNKNOWN = "und"
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Byte strings of the vocabulary with a hash lookup for all substrings of many words at once."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                if piece and b" " not in piece[1:]:
                    found.add(piece)
        self.texts = sorted(found)
        keys = np.array([self._key(x) for x in self.texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order.astype(np.int32)
        self.lengths = np.array([len(x) for x in self.texts], np.int32)
        self.longest = int(min(self.lengths.max(), WORD_BYTES + 1))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True

    @staticmethod
    def _key(text: bytes) -> int:
        h = 0
        for b in text:
            h = (h + b + 1) * int(_HASH) & 0xFFFFFFFFFFFFFFFF
        return h

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of all pieces in words that lie one after another; ``ends`` per byte."""
        h = np.zeros(len(data), np.uint64)
        at = np.arange(len(data), dtype=np.int32)
        places, numbers = [], []
        for size in range(1, self.longest + 1):
            room = at + size <= ends[at]
            at, h = at[room], h[room]
            if not len(at):
                break
            h = (h + data[at + size - 1] + np.uint64(1)) * _HASH
            near = np.flatnonzero(self.bits[h >> np.uint64(42)])
            slot = np.searchsorted(self.keys, h[near])
            slot[slot == len(self.keys)] = 0
            same = self.keys[slot] == h[near]
            places.append(at[near[same]])
            numbers.append(self.numbers[slot[same]])
        return np.concatenate(places), np.concatenate(numbers)


@lru_cache(maxsize=1)
def _pieces(vocabulary: str) -> Pieces:
    return Pieces(vocabulary)


class Lattice:
    """All segmentations of many distinct words: ``forward`` and ``expected`` run over them together."""

    def __init__(self, pieces: Pieces, data: np.ndarray, sizes: np.ndarray):
        n = sizes + 1
        ends = np.cumsum(n)
        begins = ends - n
        body = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        inside = np.ones(len(body), bool)
        inside[begins] = False
        body[inside] = data
        if len(body):
            place, number = pieces.matches(body, np.repeat(ends.astype(np.int32), n))
        else:
            place, number = np.zeros(0, np.int32), np.zeros(0, np.int32)
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)[place]
        step = (place - begins.astype(np.int32)[word]).astype(np.int16)
        order = np.argsort(step, kind="stable")
        # A word of n bytes has n + 1 nodes.
        self.node = (place + word)[order]
        self.number = number[order]
        self.target = self.node + pieces.lengths[self.number]
        self.word = word[order]
        bounds = np.searchsorted(step[order], np.arange(int(n.max()) + 1 if len(n) else 1))
        self.slices = [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]
        self.begin, self.end = begins + np.arange(len(n)), ends + np.arange(len(n))
        self.nodes = len(body) + len(n)
        self.bytes = n

    def _weights(self, scaled: np.ndarray, part: slice) -> np.ndarray:
        return scaled[self.number[part]]

    def forward(self, scaled: np.ndarray) -> np.ndarray:
        sums = np.zeros((self.nodes, scaled.shape[1]))
        sums[self.begin] = 1
        for part in self.slices:
            sums[self.target[part]] += sums[self.node[part]] * self._weights(scaled, part)
        return sums

    def likelihood(self, scaled: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        return np.log(self.forward(scaled)[self.end]) - self.bytes[:, None] * np.log(SCALE)

    def expected(self, scaled: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language, for words seen ``counts`` times."""
        ahead = self.forward(scaled)
        behind = np.zeros_like(ahead)
        behind[self.end] = 1
        out = np.zeros((len(scaled), counts.shape[1]))
        share = counts / ahead[self.end]
        for part in reversed(self.slices):
            after = behind[self.target[part]] * self._weights(scaled, part)
            # Several pieces start at one node, so these sums collect.
            node = self.node[part] - self.begin[self.word[part]]
            assert (node == node[0]).all()
            words, at = np.unique(self.word[part], return_inverse=True)
            for k in range(ahead.shape[1]):
                behind[self.begin[words] + node[0], k] = np.bincount(at, weights=after[:, k])
            weight = ahead[self.node[part]] * after * share[self.word[part]]
            for k in range(weight.shape[1]):
                out[:, k] += np.bincount(self.number[part], weights=weight[:, k], minlength=len(scaled))
        return out


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and sizes of the distinct words of a column, the word of each place, and its text."""
    words = Words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), NOT_SPACE)
    owner = words.owners()
    size = words.ends - words.starts
    if len(size) and size.max() > WORD_BYTES:
        parts = -(-size // WORD_BYTES)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(words.starts, parts) + nth * WORD_BYTES
        words.ends = np.minimum(starts + WORD_BYTES, np.repeat(words.ends, parts))
        words.starts, owner = starts, np.repeat(owner, parts)
        size = words.ends - words.starts
    _, first, each = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return words.data[ragged(words.starts[first], size[first])], size[first], each, owner


def word_counts(docs: DataFrame, *, text: str, lang: str) -> DataFrame:
    """(lang, word, n): how often each word occurs in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            langs = batch.column("lang").dictionary_encode()
            data, size, each, owner = _distinct(batch.column("text"))
            if not len(each):
                continue
            names = langs.dictionary
            pair, n = np.unique(langs.indices.to_numpy()[owner] * len(size) + each, return_counts=True)
            word = pair % len(size)
            starts = np.cumsum(size) - size
            sizes = size[word]
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            body = pa.py_buffer(data[ragged(starts[word], sizes)])
            out = pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(pair // len(size))).cast(pa.string()),
                    pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(bounds), body]),
                    pa.array(n, pa.int64()),
                ],
                names=["lang", "word", "n"],
            )
            for row in range(0, out.num_rows, 50_000):
                yield out.slice(row, 50_000)

    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    return source.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")
    )


@dataclass(frozen=True)
class LanguageModel:
    """``weights[piece, language]``: probabilities, each times ``SCALE`` for every byte of its piece."""

    vocabulary: str
    langs: tuple[str, ...]
    weights: np.ndarray


def _scaled(pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    return probability * (SCALE ** pieces.lengths.astype(float))[:, None]


def _expected(counts: DataFrame, vocabulary: str, langs: list[str], scaled: np.ndarray) -> np.ndarray:
    shared = counts.sparkSession.sparkContext.broadcast(scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        number = pa.array(langs, pa.string())
        total = np.zeros((len(pieces.texts), len(langs)))
        for batch in batches:
            if not batch.num_rows:
                continue
            which = pc.index_in(batch.column("lang"), number).to_numpy()
            word = batch.column("word").dictionary_encode()
            n = np.zeros((len(word.dictionary), len(langs)))
            np.add.at(n, (word.indices.to_numpy(), which), batch.column("n").to_numpy())
            sizes = pc.binary_length(word.dictionary).to_numpy()
            data = np.frombuffer(b"".join(word.dictionary.to_pylist()), np.uint8)
            total += Lattice(pieces, data, sizes).expected(shared.value, n)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])],
            names=["piece", "lang", "n"],
        )

    rows = (
        counts.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    ).toPandas()
    out = np.zeros((len(scaled), len(langs)))
    out[rows["piece"], rows["lang"]] = rows["n"]
    return out


def train(
    docs: DataFrame, vocabulary: str, *, text: str = "text", lang: str = "lang", rounds: int = 2, smoothing: float = 0.1
) -> LanguageModel:
    """Piece probabilities of every language in ``lang``, from all rows where text and language are not null.

    The first round starts from equal probabilities. The driver holds languages x pieces numbers, whatever
    the size of the corpus; word counts are summed in Spark and stay in the shared folder.
    """
    pieces = _pieces(vocabulary)
    counts = staged(word_counts(docs, text=text, lang=lang))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    probability = np.full((len(pieces.texts), 1), 1 / len(pieces.texts))
    for _ in range(rounds if langs else 0):
        n = _expected(counts, vocabulary, langs, _scaled(pieces, probability)) + smoothing
        probability = n / n.sum(axis=0)
    return LanguageModel(vocabulary, tuple(langs), _scaled(pieces, probability))


def identify(
    docs: DataFrame,
    model: LanguageModel,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` (all by default) with the most probable language and its posterior.

    Only ``text`` is read for the prediction. A text that is null or has no letter, and any text where no
    language was learned, gets ``und`` and 0. Equal posteriors go to the first language in order. Input
    columns with one of the two new names are replaced; rows are neither joined nor moved, so null and
    repeated ids do not matter.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    langs, vocabulary = model.langs, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        answers = pa.array([*langs, UNKNOWN], pa.string())
        for batch in steps(batches, "text", STEP_BYTES):
            column = batch.column("text")
            best = np.full(batch.num_rows, len(langs))
            score = np.zeros(batch.num_rows)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)
            if langs and pc.any(letters).as_py():
                data, size, each, owner = _distinct(column)
                word = Lattice(pieces, data, size).likelihood(shared.value)
                total = np.stack(
                    [np.bincount(owner, weights=word[each, k], minlength=batch.num_rows) for k in range(len(langs))], 1
                )
                total -= total.max(axis=1, keepdims=True)
                posterior = np.exp(total)
                posterior /= posterior.sum(axis=1, keepdims=True)
                has = letters.to_numpy(zero_copy_only=False)
                best = np.where(has, posterior.argmax(axis=1), best)
                score = np.where(has, posterior.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), answers.take(pa.array(best)), pa.array(score)], names=["kept", "lang", "score"]
            )

    source = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{text}`").cast("string").alias("text")
    )
    schema = T.StructType(
        [
            T.StructField("kept", source.schema["kept"].dataType),
            T.StructField("lang", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    out = source.mapInArrow(run, schema)
    return out.select(
        *(F.col("kept").getField(c).alias(c) for c in keep), F.col("lang").alias(names[0]), F.col("score").alias(names[1])
    )
