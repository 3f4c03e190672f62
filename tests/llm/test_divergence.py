import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palaver.llm import divergence
from palaver.llm.transducer import Transducer

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, lang string, source string, text string, gid string, term string, n int, ordinal string"


def brute(rows, least, top):
    docs = [(a or "", s or "", TERM.findall((t or "").translate(LOWER))) for a, s, t in rows]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang in sources:
        kept = sorted(t for t, n in df[lang].items() if n >= least)

        def share(source, lang=lang, kept=kept):
            c = counts[lang, source]
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        all_ = share(None)
        shares = {s: share(s) for s in sources[lang]}
        for s, p in shares.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o.encode(), o) for o, q in shares.items() if o != s]
            marks = [(-((p[t] - all_[t]) ** 2 // (p[t] + all_[t])), t.encode(), t) for t in kept if counts[lang, s][t] and p[t] > all_[t]]
            for part, items, most in (("pair", pairs, None), ("term", marks, top)):
                out += [(lang, s, part, x[2], -x[0], i) for i, x in enumerate(sorted(items)[:most], 1)]
    return sorted(out)


def rows_for(seed, n=120):
    rng = random.Random(seed)
    words = ["Ab", "ab", "abc", "b", "É", "é", "zz9x", "x-y", "straße", "日本", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S2", "ü", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]
    return [*rows, ("xx", "only", "few terms"), ("xx", "two", None), ("yy", "alone", ""), ("en", "s1", "ab " * 60_000), ("en", "empty", None)]


def audit(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "a", "b", 1, "c") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


@pytest.mark.parametrize("least, top", [(10, 10), (2, 3)])
def test_audit_equals_plain_counts(spark, least, top):
    rows = rows_for(least)
    assert audit(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_small_cells_and_shards(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 4)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    rows = rows_for(9)
    assert audit(spark, rows, least=2) == brute(rows, 2, 10)


def test_terms_travel_when_transducers_are_large(spark):
    docs = spark.createDataFrame([(a or "", s or "", t or "") for a, s, t in rows_for(4)], "lang string, source string, text string")
    terms = divergence.vocabulary(docs, 2)
    one, two = (sorted(map(tuple, divergence.count_kept(docs, terms, n).select("lang", "source", "ordinal", "n").collect())) for n in (10**9, 0))
    assert one == two and one


def test_empty_table(spark):
    assert audit(spark, []) == []


def spans(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return data, ends - [len(w) for w in words], ends


@pytest.mark.parametrize("seed", range(6))
def test_ordinals_of_a_minimal_transducer(seed):
    rng = random.Random(seed)
    terms = sorted({bytes(rng.choices(b"abc\xc3", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 300))})
    built = Transducer.of_parts(*Transducer.build(terms).parts())
    others = [bytes(rng.choices(b"abcd\xc3", k=rng.randint(1, 8))) for _ in range(200)]
    place = {t: i for i, t in enumerate(terms)}
    assert built.find(*spans(terms + others)).tolist() == [place.get(w, -1) for w in terms + others]
    tails = {frozenset(t[i:] for t in terms if t.startswith(p[:i])) for p in terms for i in range(len(p) + 1)}
    assert len(built.final) == len(tails)


def test_transducer_of_nothing_and_of_wrong_order():
    assert Transducer.build([]).find(*spans([b"a"])).tolist() == [-1]
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
