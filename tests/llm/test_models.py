import itertools
import math
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palaver.llm import language, topk, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def ranked(vectors, queries, k):
    out = []
    for q, qv in queries:
        scores = sorted((-sum(a * b for a, b in itertools.zip_longest(qv, v, fillvalue=0)), i) for i, v in vectors if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_top_k_equals_brute_force(frame, block):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(6)], 1) for i in range(120)]
    rows += [(120, None, 1), (121, [1.0, None], 1), (122, [float("nan")], 1), (123, [float("inf"), 1.0], 1), (None, [1.0], 1)]
    rows += [(130, [1.0, 2.0], 1), (140, [], 1), (7, [9.0] * 6, 1), (10, [0.25] * 6, 1)]
    df = frame(rows, "vec_id long, embedding array<float>, score int")
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_queries=block)
    want = ranked(good, [g for g in good if g[0] % 10 == 0], 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_small_tables(frame):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(frame([], schema), F.col("vec_id") >= 0).count() == 0
    assert topk.top_k(frame([(1, [1.0])], schema), F.col("vec_id") >= 0).count() == 0
    assert topk.top_k(frame([(1, [1.0]), (2, [1.0])], schema), F.col("vec_id") > 5).count() == 0
    big = frame([(i, [1e6 * i, 3e6]) for i in range(4)], schema)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(big, F.col("vec_id") == 3).collect()}
    assert got[3, 1] == (2, 768000000 * 512000000 + 768000000**2)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(PIECES)
    words = [b"the", b"\xc3\xa9t\xc3\xa9", b"a", b"zzzz"]
    rng = np.random.default_rng(1)
    probability = rng.random((len(pieces.texts), 2))
    scaled = language._scaled(pieces, probability)
    sizes = np.array([len(w) for w in words])
    lattice = language.Lattice(pieces, np.frombuffer(b"".join(words), np.uint8), sizes)
    number = {t: i for i, t in enumerate(pieces.texts)}

    def cuts(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if text[:n] in number:
                for rest in cuts(text[n:]):
                    yield [number[text[:n]], *rest]

    counts = np.array([[1.0, 0], [2, 1], [0, 3], [1, 1]])
    expected = np.zeros((len(pieces.texts), 2))
    for w, (got, n) in zip(words, zip(lattice.likelihood(scaled), counts, strict=True), strict=True):
        every = list(cuts(b" " + w))
        value = [sum(np.prod(probability[c, k]) for c in every) for k in range(2)]
        assert np.allclose(got, np.log(value))
        for c in every:
            for i in c:
                expected[i] += n * np.prod(probability[c], axis=0) / value
    assert np.allclose(lattice.expected(scaled, counts), expected)


def test_language_is_learned_and_odd_texts_have_results(frame, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train, rest = docs.where("doc_id % 3 != 1"), docs.where("doc_id % 3 = 1")
    model = language.train(train.unionByName(frame([(1, None, None, "s", 1)], docs.schema)), PIECES)
    found = language.identify(rest, model)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    share = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
    odd = frame([(None, None, 1), (1, "", 2), (1, "12 !?", 3), (1, "x" * 300_000, 4), (1, "漢", 5)], "doc_id long, text string, score int")
    got = {r.n: r for r in language.identify(odd.withColumn("n", F.col("score")), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred in model.langs and got[5].lang_pred in model.langs
    none = language.train(docs.where("false"), PIECES)
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0


def categories():
    return {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def test_chain_finds_held_out_toxic_texts(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    seen = F.xxhash64("doc_id") % 4 != 0
    chain = toxicity.fit_chain(docs, labels.where(seen), categories())
    rest = toxicity.predict(docs.where(~seen), chain, keep=["doc_id"]).join(labels, "doc_id")
    row = rest.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("is_toxic").cast("int"))).alias("found"),
        F.avg(F.when(F.col("toxic") == 0, F.col("is_toxic").cast("int"))).alias("wrong"),
        F.avg(F.when(F.col("quality") == 0, F.col("is_junk").cast("int"))).alias("junk"),
    ).first()
    assert row.found > 0.75 and row.wrong < 0.01 and row.junk > 0.9


def test_chain_odd_rows(frame):
    schema = "doc_id long, text string, p_toxic string"
    rows = [(i, ("vile thing " if i % 4 == 0 else "fine thing ") * 3, "x") for i in range(60)]
    rows += [(None, None, "y"), (99, "", "z"), (0, "vile " * 50_000, "w")]
    labels = frame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (98, None, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(rows, schema)
    chain = toxicity.fit_chain(docs, labels, categories(), sample_rows=50)
    got = toxicity.predict(docs, chain).collect()
    assert len(got) == len(rows) and all(0 <= r.p_toxic <= 1 and 0 <= r.p_junk <= 1 for r in got)
    assert all(r.is_toxic == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 60)
    empty = toxicity.fit_chain(docs, labels.where("false"), categories())
    assert not any(r.is_toxic for r in toxicity.predict(docs, empty).collect())
    assert toxicity.predict(docs.where("false"), chain).count() == 0


def test_thresholds_and_products():
    y = np.array([1.0, 1, 0, 0])
    assert 0.3 < toxicity._best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), y) < 0.8
    rows = toxicity._Rows(np.array([0, 0, 1]), np.array([0, 2, 1]), np.array([[1.0], [2.0]]), 3)
    full = np.array([[1, 0, 1, 1], [0, 1, 0, 2]])
    w = np.array([1.0, 2, 3, 4])
    assert np.allclose(rows.times(w), full @ w) and np.allclose(rows.back(np.array([5.0, 7])), full.T @ [5, 7])


def test_words_of_slices():
    from palaver.llm.words import NOT_SPACE, Words

    column = pa.array(["a b", None, "", " c\td ", "é  f"]).slice(1)
    words = Words(column, NOT_SPACE)
    assert words.counts.tolist() == [0, 0, 2, 2]
    assert [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)] == ["c", "d", "é", "f"]
