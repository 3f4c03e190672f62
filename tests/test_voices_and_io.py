import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palaver.functions import vectors as V
from palaver.functions.idents import csv_row_id, hash_id48, hash_ids48
from palaver.operators import glossary as G
from palaver.operators import voices as O
from palaver.schemas import CONVERSATIONS, align
from palaver.session import scratch_dir
from palaver.sources import files, journal_csv, tables

PROFILES = "name string, embedding array<double>, enabled boolean, model string"


def test_gate_verdicts(spark):
    s = math.sqrt(1 - 0.84**2)
    vec = spark.createDataFrame([(i, [0.84, s, 0.0]) for i in range(5)], "vec_id int, embedding array<double>")
    one = spark.createDataFrame([("a", [1.0, 0.0, 0.0], False, "m")], PROFILES)
    for limit in (10**6, 0):
        none = O.decide(O.best_and_second(vec, O.enabled(one), broadcast_elements=limit))
        assert {r.reason for r in none.collect()} == {"no_enrolled_speakers"}
        two = spark.createDataFrame([("a", [1.0, 0.0, 0.0], True, "m"), ("b", [1.0, 0.0, 0.0], True, "m")], PROFILES)
        got = O.decide(O.best_and_second(vec, O.enabled(two), broadcast_elements=limit)).collect()
        assert [r.reason for r in got] == ["ambiguous_or_overlap"] * 5
        three = one.withColumn("enabled", F.lit(True))
        got = O.decide(O.best_and_second(vec, three, broadcast_elements=limit)).collect()
        assert {(r.reason, r.speaker) for r in got} == {("matched", "a")}


def test_spans_need_agreement(spark):
    rows = [("r", i * 16_000, i * 16_000 + 32_000, "a" if i < 2 else None, 0.9, 96_000) for i in range(5)]
    w = spark.createDataFrame(rows, "source_id string, w_start bigint, w_end bigint, speaker string, similarity double, n_samples bigint")
    got = [(r.start_sample, r.end_sample, r.speaker) for r in O.span_voting(w).collect()]
    assert got == [(0, 32_000, "a")]


def test_vector_functions(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    row = spark.range(1).select(V.dot(a, b), V.cosine(a, b), V.rms_db(F.array(F.lit(0.0))), V.peak(V.normalize_gain(a, 0.0)), V.similarity_to_confidence(F.lit(0.8), 0.8)).first()
    assert row[0] == 24.0 and abs(row[1] - 0.96) < 1e-6 and row[2] == -100.0
    assert abs(row[3] - 0.99) < 1e-9 and row[4] == 0.0


def test_identifiers(spark):
    import hashlib
    import json

    t = ["2024-01-01T10:00:00+05:30", "x", 'say "hi"\nआज', "owner", ""]
    row = spark.createDataFrame([tuple(t)], "a string, b string, c string, d string, e string")
    got = row.select(csv_row_id(*[F.col(c) for c in "abcde"]), hash_id48(F.col("a")), hash_ids48(F.array("b", "a"))).first()
    assert got[0] == "csv-" + hashlib.sha256(json.dumps(t, ensure_ascii=False).encode()).hexdigest()
    assert got[1] == int.from_bytes(hashlib.sha256(t[0].encode()).digest()[:6], "big")
    joined = "\n".join(sorted(t[:2]))
    assert got[2] == int.from_bytes(hashlib.sha256(joined.encode()).digest()[:6], "big")


HEADER = "date,start_time,end_time,text,language,speaker,engine\n"


def csv_file(tmp_path, body):
    f = tmp_path / "in.csv"
    f.write_text(HEADER + body, encoding="utf-8")
    return str(f)


def test_import_is_idempotent_and_atomic(spark, tmp_path):
    good = '2024-01-05,10:00:00,10:00:05,"first line\nsecond ""quoted""",hi,owner,x\n'
    ready = journal_csv.prepare(journal_csv.read_csv(spark, csv_file(tmp_path, good)))
    row = ready.first()
    assert row.text_raw == 'first line\nsecond "quoted"' and row.end_us - row.start_us == 5_000_000
    assert journal_csv.split_new(ready, ready.limit(0)).count() == 1
    assert journal_csv.split_new(ready, ready).count() == 0
    bad = good + "2024-01-05,10:00:05,10:00:00,late,hi,owner,x\n"
    with pytest.raises(ValueError):
        journal_csv.prepare(journal_csv.read_csv(spark, csv_file(tmp_path, bad)))
    with pytest.raises(ValueError):
        journal_csv.prepare(journal_csv.read_csv(spark, csv_file(tmp_path, good + good)), max_rows=1)


def test_exported_rows_come_back(spark):
    conv = spark.createDataFrame(
        [(1, "2024-01-05", "10:00:00", "10:01:00", 'a "b"\nc', "", ["hi"], ["owner", "partner"])],
        "conversation_id bigint, date string, start_time string, end_time string, transcript string, "
        "raw_transcript string, languages array<string>, participants array<string>",
    )
    members = spark.createDataFrame([], "conversation_id bigint, segment_id string, start_us bigint, engine string")
    path = scratch_dir(spark, "t") + "/out"
    journal_csv.write_csv(journal_csv.export_rows(conv, members), path)
    row = journal_csv.read_csv(spark, path).first()
    assert (row.text, row.language, row.speaker, row.engine) == ('a "b"\nc', "hi", "owner,partner", "legacy")


def test_insert_twice_adds_nothing(spark):
    path = scratch_dir(spark, "t") + "/table"
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (2, "2024-01-02")], "k bigint, date string")
    for _ in range(2):
        out = tables.insert_new(spark, path, rows, "k", "k bigint, date string")
    assert sorted(r.k for r in out.collect()) == [1, 2]


def test_replace_keeps_the_old_id(spark):
    old = spark.createDataFrame([("a", 1, "x")], "key string, id int, v string")
    new = spark.createDataFrame([("a", 7, "y"), ("b", 8, "z")], "key string, id int, v string")
    got = sorted(tuple(r) for r in G.replace_by_key(old, new, "key", "id").collect())
    assert got == [("a", 1, "y"), ("b", 8, "z")]
    assert sorted(r.id for r in G.replace_by_key(old, new, "key").collect()) == [7, 8]


def test_glossary_merges_scripts(spark):
    conv = spark.createDataFrame(
        [(1, "2024-01-01", "बेटा betaa betaa"), (2, "2024-01-03", "betaa calls"), (3, "2024-01-02", "calls")],
        "conversation_id bigint, date string, transcript string",
    )
    occ = G.term_occurrences(conv)
    c = {r.term_key: r for r in G.candidate_terms(occ).collect()}
    b = c["betaa"]
    assert (b.term, b.term_devanagari, b.occurrences, b.conversations, b.days) == ("betaa", "बेटा", 4, 2, 2)
    assert sorted(r.term_key for r in G.recurrent(G.candidate_terms(occ)).collect()) == ["betaa"]
    ex = [(r["rank"], r.conversation_id) for r in G.top_examples(occ, conv).filter("term_key = 'betaa'").orderBy("rank").collect()]
    assert ex == [(1, 2), (2, 1), (3, 1)]


def test_paths_and_staged_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "in/2024-01-05/a.wav"), (2, "b/2024-01-05/a.wav"), (3, "x/2024-13-05/a.wav")], "i bigint, p string")
    got = [(r.dir, r.name) for r in files.layout_paths(rows, "p", "i", "none").orderBy("i").collect()]
    assert got == [("2024-01-05", "a.wav"), ("2024-01-05", "a_1.wav"), ("none", "a.wav")]
    f = tmp_path / "s.json"
    f.write_text('{"segment_id":"a","duration_seconds":2.0,"sample_rate":16000,"captured_at":"2"}\n{"segment_id":"b",\n{"segment_id":"c","duration_seconds":-1.0}\n')
    staged = files.scan_staged(spark, str(f)).cache()
    r = files.corrupt_report(staged).first()
    assert (r.valid, r.invalid, r.status) == (1, 2, "needs_attention")
    p = files.pending(staged, 5).first()
    assert (p.core_start_samples, p.core_end_samples) == (0, 32_000)


def test_schema_alignment(spark):
    row = align(spark.createDataFrame([("t",)], "transcript string"), CONVERSATIONS, {"raw_transcript": "transcript"}).first()
    assert row.raw_transcript == "t" and row.slug is None and row.conversation_id is None


def test_scoring_holds_few_similarities_at_a_time():
    r = np.random.default_rng(5)
    vectors, matrix, group = pd.Series(list(r.normal(size=(3000, 8)))), r.normal(size=(5000, 8)), np.arange(5000) // 2
    tracemalloc.start()
    top, best, second = O.two_best(vectors, group, matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all similarities at once are 120 MB
    for i in (0, 199, 200, 2999):
        per = (matrix @ vectors[i]).reshape(-1, 2).max(axis=1)
        assert top[i] == per.argmax() and np.allclose([best[i], second[i]], sorted(per)[:-3:-1])
    assert np.isnan(O.two_best(vectors[:3], np.zeros(4, int), matrix[:4])[2]).all()
