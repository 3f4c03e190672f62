import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palaver.llm.packing import cheapest_cuts, pack
from palaver.llm.tokenize import WordEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "don't they'LL 'S", "áb É× x÷y", "<|endoftext|>abc", "AB12 3,4..!?", "", None, "ΣΑΣ Σ 漢字", "a\x1cb\x7f",
    "it's me<|startoftext|>", "İstanbul ŸZ ſ", "ab<c|d> <| x", '"q"’s’t', "é ́x", " \n\t ", "ﬁ ½ ①",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_ids_equal_the_library(texts):
    import pyarrow as pa

    encoder = WordEncoder(VOCABULARY)
    ids, counts = encoder.encode(pa.array([*texts, *ODD], pa.string()))
    want = encoder.tokenizer.encode_batch([t or "" for t in [*texts, *ODD]], add_special_tokens=False)
    assert counts.tolist() == [len(x.ids) for x in want]
    assert ids.tolist() == [i for x in want for i in x.ids]


def brute_cost(places, penalty, window, window_cost):
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for i in range(1, len(places)):
        for j in range(i):
            n = places[i] - places[j]
            if n <= window:
                pad = 0 if n & (n - 1) == 0 else window - n
                best[i] = min(best[i], best[j] + pad + window_cost + penalty[i])
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=25), st.randoms())
def test_cuts_are_cheapest(gaps, random):
    places = np.cumsum([0, *gaps])
    penalty = np.array([random.choice([0, 2, 5]) for _ in places])
    cuts = cheapest_cuts(places, penalty, 16, 3)
    ends = places[cuts]
    assert ends[-1] == places[-1]
    lengths = np.diff([0, *ends])
    assert lengths.max() <= 16
    cost = sum((0 if n & (n - 1) == 0 else 16 - n) + 3 for n in lengths.tolist()) + penalty[cuts].sum()
    assert cost == brute_cost(places.tolist(), penalty.tolist(), 16, 3)


def test_each_id_lies_in_one_piece(frame, tokenizer):
    texts = [*ODD, "One two. Three four! " * 400, "word " * 3000, "x" * 5000, "same", "same"]
    rows = [(None if i == 3 else i % 17, t, i) for i, t in enumerate(texts)]
    docs = frame(rows, "doc_id long, text string, start int")
    pieces = pack(docs, VOCABULARY, window=64, stride=16, block_bytes=4000).collect()
    found = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        found.setdefault(p.sequence_id, []).append(p)
    whole = []
    for parts in found.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at <= 64
        whole += parts
    whole.sort(key=lambda p: (p.sequence_id, p.offset))
    docs_seen, current = [], b""
    for p in whole:
        assert p.start == len(current) // 4
        current += p.ids
        if len(current) == 4 * p.doc_tokens:
            docs_seen.append((p.doc_id, zlib.crc32(current)))
            current = b""
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(docs_seen, key=str) == sorted(want, key=str)


def test_no_rows(frame):
    assert pack(frame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_little_padding(frame):
    docs = frame([(i, "Some words go here. " * (5 + i % 40)) for i in range(400)], "doc_id long, text string", 1)
    sizes = [r.n for r in pack(docs, VOCABULARY).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.02 * sum(sizes)
