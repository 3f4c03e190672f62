import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.functions import evaltext as E
from palaver.functions import quality as Q
from palaver.functions import romanize as R
from palaver.functions import text as X
from palaver.functions import timefmt as D
from palaver.functions import editdist
from palaver.functions.editdist import distance, split_distance
from palaver.operators.accuracy import full_report, score_pairs
from palaver.operators.scoring import score_texts
from palaver.operators.search import bm25_search


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def run(spark, values, fn, kind="string"):
    return [r[0] for r in col(spark, values, kind).select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "text,language,want",
    [
        ("hello दोस्त", "hi", None),
        ("hello", "en", None),
        ("привет", "en", "unexpected_script"),
        ("こんにちは", "hi", "unexpected_script"),
        ("hello", "ur", "unexpected_language"),
        ("hello", "ru", "unexpected_language"),
    ],
)
def test_language_policy(spark, text, language, want):
    assert run(spark, [text], lambda v: Q.language_policy(v, F.lit(language))) == [want]


@pytest.mark.parametrize(
    "text,logprob,want",
    [
        ("thanks for watching", -0.1, "ok"),
        ("thanks for watching", -2.0, "suspected_hallucination"),
        ("", -0.1, "rejected_silence"),
        ("fine words", -2.0, "low_confidence"),
    ],
)
def test_assess(spark, text, logprob, want):
    seg = F.array(F.struct(F.lit(0.0).alias("no_speech_prob"), F.lit(logprob).alias("avg_logprob"), F.lit(1.0).alias("compression_ratio")))
    got = col(spark, [text]).withColumn("loop", Q.repetition_loop(F.col("v")))
    row = got.select(Q.assess_status(F.col("v"), F.lit("en"), Q.any_low_segment(seg), F.col("loop"))).first()
    assert row[0] == want


def loop_by_hand(s, threshold):
    c = "".join(s.split())
    if len(c) < 12:
        return False
    for n in range(1, 5):
        k = max(Counter(c[i : i + n] for i in range(len(c) - n + 1)).values())
        if k >= (8 if n == 1 else 5) and k * n / len(c) > threshold:
            return True
    return False


def test_repetition_loop_against_counting(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab हि") for _ in range(r.randrange(60))) for _ in range(120)]
    texts += ["हा" * 20, "ha ha ha ha ha ha ha", "plain words that do not repeat", "abcd" * 6 + "zyxwvut"]
    for th in (0.4, 0.3):
        assert run(spark, texts, lambda v: Q.repetition_loop(v, th)) == [loop_by_hand(t, th) for t in texts]


def test_language_correction(spark):
    got = run(spark, ["नमस्ते", "kya haal", "hello there", "привет"], lambda v: Q.correct_language(v, F.lit("ru")))
    assert got == ["hi", "hi", "en", "ru"]


@pytest.mark.parametrize("nsp,lp,want", [(0.1, -0.2, False), (0.7, -0.2, True), (0.1, -1.5, True)])
def test_low_confidence(spark, nsp, lp, want):
    assert spark.range(1).select(Q.low_confidence(F.lit(nsp), F.lit(lp))).first()[0] is want


def test_scores_and_reasons(spark):
    rows = [
        ("thank you", 2, False), ("please read the book", 4, False), ("haan haan haan", 3, False),
        ("um uh", 2, False), ("a clear short sentence here", 5, True), ("two words", 2, False),
        ("go up go up go up", 6, False),
    ]
    df = spark.createDataFrame(rows, "text string, word_count int, low_confidence boolean").withColumn("confidence", F.lit(0.95))
    got = {r.text: (round(r.score, 3), r.reason) for r in score_texts(df).collect()}
    assert got["thank you"] == (0.0, "media_artifact; short_media_phrase")
    assert got["please read the book"] == (0.0, "media_artifact")
    assert got["haan haan haan"] == (0.0, "repetitive(haanx3)")
    assert got["um uh"] == (0.0, "too_short_filler")
    assert got["a clear short sentence here"] == (0.7, "ok")
    assert got["two words"] == (0.8, "ok")
    assert got["go up go up go up"] == (0.0, "phrase_repetition(go upx3)")


def test_word_boundary_option_spares_book(spark):
    assert run(spark, ["read the book", "ok", "that is ok"], lambda v: Q.media_artifact(v, word_boundary=True)) == [False, True, True]


def test_terms(spark):
    assert run(spark, ["यार beta is éable ok123 haa"], R.potential_terms) == [["यार", "beta", "is", "haa"]]
    assert run(spark, ["यार", "Yāra ", "बेटा", "ḥṛ"], R.match_key) == ["yaar", "yara", "betaa", "hri"]
    assert run(spark, ["यार", "YAAR", "zindagi"], R.is_common) == [True, True, False]
    assert run(spark, ["beta", "aaab", "aabb", "aab", "x"], R.is_valid_term) == [True, False, True, False, False]


def test_voice_commands(spark):
    tag, note = X.voice_command(F.col("v"))
    rows = col(spark, ["Note: Buy milk", "remind me to call", "to-do: fix", "nothing", "add a todo paint"]).select(tag, note).collect()
    assert [tuple(r) for r in rows] == [("note", "buy milk"), ("reminder", "call"), ("todo", "fix"), (None, None), ("todo", "paint")]


def test_times(spark):
    us = 1_704_096_000_000_000  # 2024-01-01 08:00 UTC is 13:30 in the journal zone
    row = spark.range(1).select(D.local_date(F.lit(us)), D.local_time(F.lit(us)), D.format_time_12h(F.lit("00:05:09")), D.format_duration(F.lit(125)), D.format_hours_minutes(F.lit(7260))).first()
    assert tuple(row) == ("2024-01-01", "13:30:00", "12:05 AM", "2m 5s", "2h 1m")
    assert run(spark, ["2024-02-29", "2023-02-29", "2024-1-01"], lambda v: D.parse_canonical_date(v).cast("string")) == ["2024-02-29", None, None]
    hour = F.col("v").cast("int")
    assert run(spark, ["21", "22", "5", "6"], lambda v: D.in_hour_window(hour, 22, 6)) == [False, True, True, False]


def test_normalize(spark):
    got = run(spark, ["Hain, 5 meetings; 20 ofis!", "हिन्दी 21", "café"], E.normalize_text)
    assert got == ["hai paanch meetings bees office", "hindii 21", "café"]


def edits_by_hand(a, b):
    row = [(j, 0, 0, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 0, i, 0)]
        for j, y in enumerate(b, 1):
            d, s, de, n = row[j - 1]
            new.append(
                min(
                    (d + (x != y), s + (x != y), de, n),
                    (row[j][0] + 1, row[j][1], row[j][2] + 1, row[j][3]),
                    (new[-1][0] + 1, new[-1][1], new[-1][2], new[-1][3] + 1),
                    key=lambda c: (c[0], c[2], c[3]),
                )
            )
        row = new
    return row[-1]


def test_edit_operations_and_distance(spark):
    r = random.Random(2)
    rows = [(i, "s", " ".join(r.choices("abcde", k=r.randrange(12))), " ".join(r.choices("abcde", k=r.randrange(12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "scenario int, system string, reference string, hypothesis string")
    for x in score_pairs(df).collect():
        d, s, de, n = edits_by_hand(x.reference.split(), x.hypothesis.split())
        assert (x.substitutions, x.deletions, x.insertions) == (s, de, n)
        a, b = len(x.reference.split()), len(x.hypothesis.split())
        want = 0.0 if a == b == 0 else 1.0 if 0 in (a, b) else d / a
        assert abs(x.wer - want) < 1e-9
        a, b = len(x.reference), len(x.hypothesis)
        want = 0.0 if a == b == 0 else 1.0 if 0 in (a, b) else edits_by_hand(x.reference, x.hypothesis)[0] / a
        assert abs(x.cer - want) < 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_bands_equal_a_plain_table(seed):
    r = random.Random(seed)
    for _ in range(25):
        a = [r.randrange(30) for _ in range(r.randrange(90))]
        b = [x for x in a if r.random() > 0.2]
        for _ in range(r.randrange(1 + 4 * seed)):
            b.insert(r.randrange(len(b) + 1), r.randrange(30))
        if r.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        d, s, de, n = edits_by_hand(a, b)
        assert split_distance(np.array(a, np.int64), np.array(b, np.int64)) == (d, s, de, n)


@pytest.mark.parametrize("seed", range(4))
def test_lists_of_words_equal_a_plain_table_and_bounded_ones_are_not_numbered(seed, monkeypatch):
    r = random.Random(seed)
    damage = {
        "lost": lambda w: [x for x in w if r.random() > 0.2],
        "twice": lambda w: [y for x in w for y in [x] * r.choice((1, 1, 2))],
        "other": lambda w: [x if r.random() > 0.2 else "?" * len(x) for x in w],
        "any": lambda w: [r.choice("abcde") for _ in range(r.randrange(20))],
    }
    for kind, heard in damage.items():
        with monkeypatch.context() as m:
            if kind != "any":
                m.setattr(editdist, "_numbers", None)
            for _ in range(40):
                a = [r.choice("abcde") for _ in range(r.randrange(20))]
                b = heard(a)
                assert editdist.split_words(a, b) == edits_by_hand(a, b)


def test_words_of_a_scenario_are_made_once(spark, capsys):
    from palaver.plans import views

    docs = spark.createDataFrame([(1, "a b c d e f g\nh i j k l m n"), (2, " \n "), (3, None), (4, "x")], "doc_id bigint, text string")
    scores = score_pairs(views.pairs(docs)).select("scenario", "system", "ref_words", "hyp_words", "wer")
    scores.explain()
    # One look at the filter and one at the words: counts come with the edits.
    assert capsys.readouterr().out.count("regexp_extract_all") == 1
    got = {(x.scenario, x.system): (x.ref_words, x.hyp_words, round(x.wer * x.ref_words)) for x in scores.collect()}
    assert got == {
        ("doc-1", "drop7"): (14, 12, 2), ("doc-1", "dup11"): (14, 15, 1), ("doc-1", "sub13"): (14, 14, 1),
        ("doc-4", "drop7"): (1, 1, 0), ("doc-4", "dup11"): (1, 1, 0), ("doc-4", "sub13"): (1, 1, 0),
    }


def test_scores_of_null_texts(spark):
    df = spark.createDataFrame([("a", "s", None, "x y"), ("b", "s", "x y", None)], "scenario string, system string, reference string, hypothesis string")
    got = {r.scenario: (r.ref_words, r.hyp_words, r.substitutions, r.deletions, r.insertions) for r in score_pairs(df).collect()}
    assert got == {"a": (None, 2, 0, 0, 2), "b": (2, None, 0, 2, 0)}


def test_long_texts_with_errors_across_line_ends(spark):
    words = [f"w{i}" for i in range(20_000)]
    heard = [w for i, w in enumerate(words) if i % 1000 != 500]
    for i in range(300, len(heard), 997):
        heard[i] = "x"
    heard[7000:7000] = ["more"] * 40
    df = spark.createDataFrame([("a", "s", "\n".join(words), " ".join(heard))], "scenario string, system string, reference string, hypothesis string")
    x = score_pairs(df).first()
    assert (x.deletions, x.substitutions, x.insertions) == (20, len(range(300, 19_980, 997)), 40)


def test_report_has_all_columns(spark):
    scores = score_pairs(spark.createDataFrame([("SILENCE", "s", "", "a b"), ("one", "s", "a b c", "a b c")], "scenario string, system string, reference string, hypothesis string"))
    segments = spark.createDataFrame([("SILENCE", "s", "a b", 0.0), ("one", "s", "ha" * 20, 0.1), ("one", "s", "a b", 2.5), ("one", "s", " ", 9.0)], "scenario string, system string, text string, compression_ratio double")
    times = spark.createDataFrame([("SILENCE", "s", 1.125, 0.0), ("one", "s", 2.0, 16.0)], "scenario string, system string, processing_time double, audio_duration double")
    got = {r.scenario: r for r in full_report(scores, segments, times).collect()}
    assert tuple(got["SILENCE"])[2:] == ("1.0000", "1.0000", 2, 0, 0, 0, 2, "0.000", "1.12", "0.00", 0, 2, 1)
    assert tuple(got["one"])[2:] == ("0.0000", "0.0000", 0, 0, 0, 3, 3, "0.125", "2.00", "16.00", 2, 0, 3)


def test_accuracy_report_against_a_plain_table(spark):
    from palaver.plans.jobs import accuracy_report

    rows = [("a", "s", "Hain, 5 meetings\nnahin", "hai paanch miting haan"), ("b", "s", "...", "um"), ("c", "s", "don't stop", "dont stop now")]
    df = spark.createDataFrame(rows, "scenario string, system string, reference string, hypothesis string")
    got = {r.scenario: r for r in accuracy_report(df).collect()}
    normal = {r.scenario: (r.r, r.h) for r in df.select("scenario", E.normalize_text(F.col("reference")).alias("r"), E.normalize_text(F.col("hypothesis")).alias("h")).collect()}
    for key, (ref, hyp) in normal.items():
        d, s, de, n = edits_by_hand(ref.split(), hyp.split())
        x = got[key]
        assert (x.substitutions, x.deletions, x.insertions, x.ref_words, x.hyp_words) == (s, de, n, len(ref.split()), len(hyp.split()))
        assert x.wer == (1.0 if not ref else d / len(ref.split()))


def test_search_modes(spark):
    df = spark.createDataFrame([(1, "the quick fox"), (2, "quick the fox fox"), (3, "Café foxes")], "id int, t string")
    ids = lambda q, m: sorted(r.id for r in bm25_search(df, q, ["t"], "id", m).collect())
    assert ids("the quick", "all") == [1, 2]
    assert ids("the quick", "phrase") == [1]
    assert ids("fox", "prefix") == [1, 2, 3]
    assert ids("cafe the", "any") == [1, 2, 3]
    assert ids("", "all") == []


@pytest.mark.parametrize("seed", range(6))
def test_repeated_phrase_equals_a_plain_loop(seed):
    r = random.Random(seed)
    for _ in range(300):
        letters = r.choice(["ab", "abc", "abcdefgh"])
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 60))]
        low = r.choice([" ", "  ", "\n"]).join(words)
        starts = [f"{a} {b}" for a, b in zip(words, words[1:])][: max(len(words) - 3, 0)]
        assert Q.first_repeated_phrase(low, 3) == next((p for p in starts if low.count(p) >= 3), None)


def test_repeated_phrase_of_a_long_text_takes_seconds_at_most():
    words = [f"w{i:05d}" for i in range(30_000)]
    began = time.perf_counter()
    assert Q.first_repeated_phrase(" ".join(words), 3) is None
    assert time.perf_counter() - began < 10


def test_distance_of_long_texts_without_a_bound_takes_seconds_at_most():
    r = np.random.default_rng(3)
    x = r.integers(0, 26, 30_000)
    y = np.delete(np.where(r.random(len(x)) < 0.08, r.integers(0, 26, len(x)), x), slice(50, None, 90))
    began = time.perf_counter()
    d = distance(x, y)
    assert abs(len(x) - len(y)) < d <= (x[: len(y)] != y).sum() + len(x) - len(y)
    assert time.perf_counter() - began < 15


def test_segments_of_a_hypothesis_hold_all_its_words(spark):
    from palaver.plans import views

    words = [f"w{i}" for i in range(3 * views.SEGMENT + 1)]
    df = spark.createDataFrame([("a", "s", 5, " ".join(words)), ("b", "s", 5, "")], "scenario string, system string, doc_id bigint, hypothesis string")
    rows = views.pair_segments(df).collect()
    got = sorted((x.compression_ratio, x.text) for x in rows if x.scenario == "a")
    assert [t for _, t in got] == [" ".join(words[i : i + views.SEGMENT]) for i in range(0, len(words), views.SEGMENT)]
    assert [c for c, _ in got] == [0.5, 0.6, 0.7, 0.8] and [x.text for x in rows if x.scenario == "b"] == [""]


def test_scenarios_are_documents_and_their_lines(spark):
    from palaver.plans import catalogue, views
    from palaver.plans.registry import Tables

    docs = Tables(spark, "/root/testdata/sf0.001").raw("documents").select("doc_id", "text").collect()
    want = {f"doc-{d}" for d, text in docs if text.split()}
    want |= {f"doc-{d}-{n}" for d, text in docs for n, line in enumerate(text.split("\n")) if line.split()}
    for name in ("cer", "system_scenario_cross"):
        rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").select("scenario", "system").collect()
        assert len(rows) == 3 * len(want) and {r.scenario for r in rows} == want
    ranked = catalogue.QUERIES["eval_ranking"](spark, "/root/testdata/sf0.001").collect()
    assert {r.scenarios for r in ranked} == {len(want)}
    heard = views.line_pairs(spark.createDataFrame([(1, "a b\n" + "c " * 13)], "doc_id bigint, text string"))
    assert {r.scenario: r.hypothesis for r in heard.where("system = 'sub13'").collect()} == {"doc-1-0": "a b", "doc-1-1": "c " * 12 + "um"}


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        above, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_character_edits_by_words_equal_a_plain_table(seed, monkeypatch):
    from palaver.functions import editdist

    r = random.Random(seed)
    monkeypatch.setattr(editdist, "_BLOCK", 7)
    for n in range(500):
        monkeypatch.setattr(editdist, "_LONG", (200, 4)[n % 2])
        letters = r.choice(["ab", "abcd", "abcdefghijklmnop"])
        word = lambda: "".join(r.choice(letters) for _ in range(r.randint(0, 5)))
        heard, words, p = [], [word() for _ in range(r.randint(0, 14))], r.random() * 0.4
        for w in words:
            u = r.random() * 3
            heard += [] if u < p else [word() for _ in range(r.randint(1, 2))] if u < 2 * p else [w] * (2 if u < 3 * p else 1)
        a, b = " ".join(words), " ".join(heard)
        assert editdist.text_distance(a, b) == plain_distance(a, b)


def test_character_edits_of_a_long_text_with_words_of_other_lengths_take_seconds_at_most():
    from palaver.functions.editdist import text_distance

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    heard = [w if i % 13 else "\ue000" * (len(w) + i // 13 % 3 - 1) for i, w in enumerate(words)]
    began = time.perf_counter()
    d = text_distance(" ".join(words), " ".join(heard))
    assert d == sum(max(len(a), len(b)) for a, b in zip(words, heard) if a != b)
    assert time.perf_counter() - began < 3


def test_texts_are_normalised_once_for_their_scores(spark):
    from palaver.plans import catalogue

    plan = catalogue.QUERIES["asr_eval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("edit_ops")]
    assert "regexp_replace" not in above
