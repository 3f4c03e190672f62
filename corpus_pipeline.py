"""A corpus pipeline of five stages over ``documents``; each stage reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm import decontaminate, jaccard_join, language, line_dedup, packing
from palaver.llm.queries import table
from palaver.llm.scratch import staged

#: A text whose most probable language has a lower posterior is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but id and text under names that no stage uses, and how they are called."""
    names = {f"col{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({c: n for n, c in names.items()}), names


def as_before(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``docs`` only, as they were called."""
    return rows.select("doc_id", "text", *names).withColumnsRenamed(names).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without letters and undecided texts go."""
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rows, names = apart(docs)
    found = language.identify(rows, model, names=("_lang", "_score"))
    good = (F.col("_lang") != language.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE_SCORE)
    return as_before(found.where(good), docs, names)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in the corpus before; those with no line left go."""
    rows, names = apart(docs)
    kept = line_dedup.dedupe_lines(rows)
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    text = as_before(kept.where(left), docs, names)
    return text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near duplicates; rows without an id come last.

    Of rows that agree in id and text too, one stays. Texts without words are in no class and all stay.
    """
    marked = staged(jaccard_join.classes(docs.select("doc_id", "text")).select("doc_id", "key", "h", "class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "key", "h")).alias("first")
    kept = marked.where("class is not null").groupBy("class").agg(first).select("first.key", "first.h", F.lit(True).alias("_one"))
    free = marked.where("class is null").select("key", "h", F.lit(False).alias("_one")).distinct()
    marks = kept.unionByName(free).withColumnsRenamed({"key": "_key", "h": "_h"})
    key, h = jaccard_join.row_key()
    rows, names = apart(docs)
    found = rows.withColumns({"_key": key, "_h": h}).join(marks, ["_key", "_h"])
    number = F.row_number().over(Window.partitionBy("_key", "_h").orderBy(F.xxhash64(F.lit(0), *names)))
    return as_before(found.withColumn("_n", number).where(~F.col("_one") | (F.col("_n") == 1)), docs, names)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a row is known by its id and a hash of its text."""
    own = F.xxhash64(F.col("doc_id").isNull(), F.col("text"))
    rows, names = apart(docs)
    keyed = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_text": own})
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), keep=("_id", "_text"))
    clean = keyed.join(found.select("_id", "_text").distinct(), ["_id", "_text"], "left_anti")
    return as_before(clean, docs, names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token windows of all documents."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("jaccard_join", unique_documents),
    ("decontamination", uncontaminated),
    ("packing", packed),
]
#: Tokens and trained models cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
