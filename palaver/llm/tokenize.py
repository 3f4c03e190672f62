"""Token ids of whole text columns with a public vocabulary, at the cost of its distinct words.

A text is cut at ASCII white space, which the vocabulary's own splitting never crosses, and each
distinct piece is encoded once. Pieces of ASCII and Latin-1 letters are split by their byte classes;
any other piece goes through the tokenizer as a whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palaver.llm.words import text_bytes

#: Distinct words that a worker remembers; the memory starts anew when it is full.
REMEMBERED = 200_000
_LETTER, _DIGIT, _OTHER, _ODD = 0, 1, 2, 3


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all slices ``starts[i]`` to ``starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordEncoder:
    """Ids of a lower-casing word vocabulary (``word_bpe_49k.json``) for Arrow text columns."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.known: dict[bytes, list[int]] = {}
        names = _byte_names()
        self.names = "".join(names[b] for b in range(256))
        kind = np.full(256, _ODD, np.uint8)
        kind[0x21:0x7F] = _OTHER
        kind[ord("0") : ord("9") + 1] = _DIGIT
        kind[ord("A") : ord("Z") + 1] = _LETTER
        kind[ord("a") : ord("z") + 1] = _LETTER
        kind[ord("'")] = _ODD
        self.kind = kind
        fold = np.arange(256, dtype=np.uint8)
        fold[ord("A") : ord("Z") + 1] += 32
        self.fold = fold

    def forget(self) -> None:
        self.known = {}
        pa.default_memory_pool().release_unused()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another as unsigned 32-bit numbers, and the number per text."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        flat = pieces.flatten()
        where = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        coded = flat.dictionary_encode()
        ids, counts = self._pieces(coded.dictionary)
        starts = np.cumsum(counts) - counts
        each = coded.indices.to_numpy()
        lengths = counts[each]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids[ragged(starts[each], lengths)], np.diff(sums[where])

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(distinct)
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        kind, data = self._kinds(data, offsets)
        odd = np.zeros(n, bool)
        filled = offsets[1:] > offsets[:-1]
        odd[filled] = np.maximum.reduceat(kind, offsets[:-1][filled]) == _ODD
        # A token begins at each digit, at each change of class and at each piece.
        begins = np.ones(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[offsets[:-1][filled]] = True
        at = np.flatnonzero(begins)
        owner = np.searchsorted(offsets, at, "right") - 1
        keep = ~odd[owner]
        ends = np.append(at[1:], len(kind))[keep]
        at, owner = at[keep], owner[keep]
        if len(at):
            sizes = ends - at
            joined = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            plain = data[ragged(at, sizes)]
            words = pa.Array.from_buffers(
                pa.large_binary(), len(at), [None, pa.py_buffer(joined), pa.py_buffer(plain)]
            ).dictionary_encode()
            lists = self._words(words.dictionary.to_pylist())
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            pool = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
            start = np.cumsum(size) - size
            each = words.indices.to_numpy()
            ids = pool[ragged(start[each], size[each])]
            counts = np.bincount(owner, weights=size[each], minlength=n).astype(np.int64)
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        strange = np.flatnonzero(odd)
        if not len(strange):
            return ids, counts
        found = self.tokenizer.encode_batch_fast(
            distinct.take(pa.array(strange)).to_pylist(), add_special_tokens=False
        )
        more = [x.ids for x in found]
        size = np.fromiter(map(len, more), np.int64, len(more))
        pool = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint32, int(size.sum()))])
        starts = np.cumsum(counts) - counts
        starts[strange] = len(ids) + np.cumsum(size) - size
        counts[strange] = size
        return pool[ragged(starts, counts)], counts

    def _kinds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each byte, and the bytes in lower case."""
        kind, low = self.kind[data], self.fold[data]
        # Two-byte Latin-1 letters begin with C3; the signs for times (97) and division (B7) are none.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[data[lead + 1] < 0x9F] + 1
        low[upper] += 32
        # Written forms of special tokens are left to the tokenizer.
        kind[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = _ODD
        return kind, low

    def _words(self, distinct: list[bytes]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, tokenize, names, out = self.known, self.model.tokenize, self.names, []
        for word in distinct:
            ids = known.get(word)
            if ids is None:
                shown = word.decode("latin-1").translate(names)
                ids = known[word] = [x.id for x in tokenize(shown)]
            out.append(ids)
        return out
