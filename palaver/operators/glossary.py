"""Recurring terms of conversations: candidates, recurrence, merging, and the glossary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.quality import contains_devanagari
from palaver.functions.romanize import (
    is_common,
    is_valid_term,
    match_key,
    potential_terms,
    romanize,
)
from palaver.functions.text import extract_context


def term_occurrences(conv: DataFrame, text: str = "transcript", min_length: int = 2) -> DataFrame:
    """One row per (conversation, date, term) with the number of occurrences and first position.

    Counting inside each conversation first keeps a frequent word from travelling once per use.
    Validity and match key are computed once per distinct spelling in a conversation.
    """
    terms = conv.select(
        "conversation_id", "date", F.posexplode(potential_terms(F.col(text))).alias("pos", "term")
    ).filter(F.length("term") >= min_length)
    per = terms.groupBy("conversation_id", "date", "term").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos")
    )
    return per.filter(is_valid_term(F.col("term")) & ~is_common(F.col("term"))).withColumn(
        "term_key", match_key(F.col("term"))
    )


def candidate_terms(occ: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """Counts, days and first-seen spelling per match key.

    First means the newest date, then the lowest conversation id, then the place in the text. Every
    aggregate merges map-side. The conversations of a term are rows of their own
    (``candidate_links``), because a frequent term has no bounded list of them.
    """
    order = F.struct(
        (-F.unix_date(F.col("date").cast("date"))).alias("d"), F.col("conversation_id"), F.col("pos")
    )
    days = occ.groupBy("term_key", "date").agg(
        F.sum("n").alias("n"),
        F.count_distinct("conversation_id").alias("conversations"),
        F.min_by("term", order).alias("term"),
        F.min(order).alias("_o"),
        F.min(F.when(contains_devanagari(F.col("term")), F.struct(order.alias("o"), F.col("term").alias("t")))).alias("_dev"),
    )
    g = days.groupBy("term_key").agg(
        F.sum("n").alias("occurrences"),
        F.sum("conversations").alias("conversations"),
        F.count("*").alias("days"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.min_by("term", "_o").alias("term"),
        F.min("_dev").alias("_dev"),
    )
    return g.filter(F.col("occurrences") >= min_occurrences).select(
        "term_key",
        "term",
        F.coalesce("_dev.t", F.lit("")).alias("term_devanagari"),
        romanize(F.col("term")).alias("term_romanized"),
        "occurrences",
        "conversations",
        "days",
        "first_seen",
        "last_seen",
    )


def candidate_links(occ: DataFrame) -> DataFrame:
    """Conversations of each term with the number of uses."""
    return occ.groupBy("term_key", "conversation_id").agg(F.sum("n").alias("n"))


def top_examples(occ: DataFrame, conv: DataFrame, text: str = "transcript", k: int = 3) -> DataFrame:
    """Up to ``k`` first examples per term, each with its surrounding text.

    The rank filter is a group limit, so each task forwards at most ``k`` rows per term before the
    shuffle. A conversation that uses a term several times gives that many examples.
    """
    w = Window.partitionBy("term_key").orderBy(F.desc("date"), "conversation_id", "pos")
    first = occ.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    uses = first.withColumn("use", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k)))))
    w2 = Window.partitionBy("term_key").orderBy("_rn", "use")
    kept = uses.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)
    with_text = kept.join(conv.select("conversation_id", text), "conversation_id")
    return with_text.select(
        "term_key", "rank", "conversation_id", extract_context(F.col(text), F.col("term")).alias("example")
    )


def recurrent(
    candidates: DataFrame, min_conversations: int = 3, min_days: int = 2, distinct_conversations: bool = False
) -> DataFrame:
    """Terms seen often enough on enough days. By default every use counts, not every conversation."""
    n = F.col("conversations" if distinct_conversations else "occurrences")
    return candidates.filter((n >= min_conversations) & (F.col("days") >= min_days))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per match key from several candidate tables."""
    return candidates.groupBy("term_key").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max(F.nullif("term_devanagari", F.lit(""))).alias("term_devanagari"),
        F.min("term_romanized").alias("term_romanized"),
    ).withColumn("term_devanagari", F.coalesce("term_devanagari", F.lit("")))


def replace_by_key(old: DataFrame, new: DataFrame, key: str, keep_id: str | None = None) -> DataFrame:
    """Upsert: the new row wins, and with ``keep_id`` an existing row keeps its id.

    A maximum by side merges map-side, so no key collects its rows.
    """
    cols = old.columns
    both = old.withColumn("_side", F.lit(0)).unionByName(new.select(*cols).withColumn("_side", F.lit(1)))
    row = F.struct(*cols)
    g = both.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(row, "_side").alias("_r"),
        *([F.min_by(keep_id, "_side").alias("_id")] if keep_id else []),
    )
    picked = [
        F.col("_id").alias(c) if c == keep_id else F.col(f"_r.{c}").alias(c) for c in cols
    ]
    return g.select(*picked)


def update_counts(glossary: DataFrame, found: DataFrame) -> DataFrame:
    """Add the counts of terms that the glossary already has and move their last date."""
    add = found.select(
        "term_key", F.col("occurrences").alias("_n"), F.col("last_seen").alias("_last")
    )
    return (
        glossary.join(add, "term_key", "left")
        .withColumn("occurrences", F.col("occurrences") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_seen", F.greatest("last_seen", F.coalesce("_last", F.col("last_seen"))))
        .drop("_n", "_last")
    )


def glossary_stats(terms: DataFrame) -> DataFrame:
    return terms.agg(
        F.count("*").alias("terms"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"),
        F.count_if("validated").alias("validated"),
        F.count_if(~F.col("validated")).alias("pending"),
    )


def glossary_entry(meaning: str = "meaning", example: str = "example"):
    """One glossary entry as Markdown, with placeholders where nothing is known yet."""
    title = F.initcap(F.col("term_romanized"))
    return F.concat(
        F.lit("## "), F.col("term_devanagari"), F.lit(" ("), title, F.lit(")\n**Romanized:** "),
        F.col("term_romanized"), F.lit("\n**First seen:** "), F.col("first_seen"),
        F.lit("\n**Occurrences:** "), F.col("occurrences").cast("string"), F.lit("\n**Meaning:** "),
        F.coalesce(F.nullif(F.col(meaning), F.lit("")), F.lit("(meaning not yet inferred)")),
        F.lit('\n**Example:** "'),
        F.coalesce(F.nullif(F.col(example), F.lit("")), F.lit("(no example available)")),
        F.lit('"\n\n---\n'),
    )
