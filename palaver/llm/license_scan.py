"""Licence scan by diagonal voting.

All rolling word k-gram hashes of a text are joined with the places of the same hashes in licence
templates. Hits are counted by (text, template, offset diagonal), neighbouring diagonals are merged, and
a merged run is verified by the share of the template's k-grams that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.words import Words, byte_table, rolling, steps

#: Phrases whose consecutive words count as base places, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices and opening words of public licences, with labels of this scan.
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl-work"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu"
        " general public license as published by the free software foundation",
        "gpl-program",
    ),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache-2.0",
    ),
    ("released under the mit license", "mit-notice"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction",
        "mit-text",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl"
        " was not distributed with this file you can obtain one at",
        "mpl-2.0",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words are runs of digits, lower-case letters and everything beyond ASCII.
WORD_BYTES = byte_table(
    "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
)
SHORT, LONG = 2, 3


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.large_string()), WORD_BYTES, lower=True)
    h = words.hashes()
    return [h[words.first[i] : words.first[i + 1]] for i in range(len(texts))]


def template_places(spark: SparkSession, phrases, notices) -> tuple[DataFrame, np.ndarray]:
    """One row per k-gram of a template, and the sorted hashes. Templates are parameters, not data."""
    rows = []
    kinds = [(p, n, True) for p, n in phrases] + [(t, n, False) for t, n in notices]
    for number, ((_, label, base), h) in enumerate(zip(kinds, _hashes([k[0] for k in kinds]), strict=True)):
        k = SHORT if base else LONG
        grams = rolling(h, k)
        for place, value in enumerate(grams.astype(np.int64).tolist()):
            rows.append((value, number, label, base, place, len(grams), len(h)))
    schema = "hash long, template int, label string, base boolean, place long, grams long, words long"
    hashes = np.unique(np.array([r[0] for r in rows], np.int64))
    return spark.createDataFrame(rows, schema), hashes


def scan_licenses(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    phrases=PHRASES,
    notices=NOTICES,
    drift: int = 4,
    coverage: float = 0.7,
) -> DataFrame:
    """Verified spans of licence phrases and notices, one row per span, and one row without a span for a
    document that has none.

    Columns: ``row`` (number of the input row), ``doc_id``, ``n_words``, ``label``, ``base``,
    ``first_word``, ``last_word`` (of the span), ``score`` (share of the template found). A phrase counts
    only whole and in one place; a notice may be broken: diagonals at most ``drift`` words apart are
    merged, and ``coverage`` of its k-grams must be there. Null texts count as empty; rows with null or
    repeated ids are scanned as they are; other columns are not read; no rows give no spans. Only hashes
    that occur in a template leave the Python step; the templates are broadcast, as they are a parameter.
    """
    places, hashes = template_places(docs.sparkSession, phrases, notices)
    bits = np.zeros(1 << 20, bool)
    bits[hashes & 0xFFFFF] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64())]))
        for batch in steps(batches, "text"):
            words = Words(batch.column("text"), WORD_BYTES, lower=True)
            h = words.hashes()
            hit_hash, hit_word = [], []
            for k in (SHORT, LONG):
                room = words.room(k)
                grams = rolling(h, k).astype(np.int64)[room]
                near = bits[grams & 0xFFFFF]
                hit_hash.append(grams[near])
                hit_word.append(room[near])
            value, word = np.concatenate(hit_hash), np.concatenate(hit_word)
            order = np.argsort(word, kind="stable")
            value, word = value[order], word[order]
            owner = np.searchsorted(words.first, word, "right") - 1
            hits = pa.StructArray.from_arrays(
                [pa.array(value, pa.int64()), pa.array(word - words.first[owner], pa.int64())], ["hash", "pos"]
            )
            bounds = np.searchsorted(word, words.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds), hits).cast(kind),
                ],
                names=["doc_id", "n_words", "hits"],
            )

    source = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    hashed = source.mapInArrow(run, "doc_id long, n_words long, hits array<struct<hash:long,pos:long>>")
    hits = (
        hashed.withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
        .select("row", "doc_id", "n_words", F.col("hit.hash").alias("hash"), F.col("hit.pos").alias("pos"))
    )
    votes = (
        hits.join(F.broadcast(places), "hash", "left")
        .withColumn("diagonal", F.col("pos") - F.col("place"))
        .groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "words", "diagonal")
        .agg(
            F.count("place").alias("votes"),
            F.min("pos").alias("low"),
            F.max("pos").alias("high"),
        )
    )
    # Neighbouring diagonals of a broken notice make one run; a phrase keeps each diagonal apart.
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | ((F.col("diagonal") - F.lag("diagonal").over(line)) > drift)
    runs = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(line)
    )
    spans = runs.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "words", "run").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("first_word"), F.max("high").alias("high")
    )
    gram = F.when(F.col("base"), SHORT).otherwise(LONG)
    score = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    whole = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(score >= coverage)
    good = F.col("template").isNotNull() & whole
    return spans.select(
        "row",
        "doc_id",
        "n_words",
        *(
            F.when(good, x).alias(n)
            for n, x in (
                ("label", F.col("label")),
                ("base", F.col("base")),
                ("first_word", F.col("first_word")),
                ("last_word", F.col("high") + gram - 1),
                ("score", score),
            )
        ),
    )
