"""Ranked full-text search over several columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import fold_accents

# Runs of letters and digits are tokens; marks and punctuation split.
LETTER = r"[\p{L}\p{N}]"
OTHER = r"[^\p{L}\p{N}]"


def _folded(col: Column) -> Column:
    return fold_accents(F.lower(F.coalesce(col, F.lit(""))))


def _pattern(phrase: list[str], prefix: bool) -> str:
    """Matches the first word of each place where the phrase stands.

    The word itself comes first, so most places fail on a plain comparison; what must not be before
    it and what must follow are only looked at, so phrases that share words all count.
    """
    first, end = phrase[0], "" if prefix else f"(?!{LETTER})"
    rest = "".join(f"{OTHER}+{w}" for w in phrase[1:])
    return f"{first}(?<!{LETTER}{first})(?={rest}{end})" if rest else f"{first}(?<!{LETTER}{first}){end}"


def _count_all(columns: list[str], pattern: str) -> Column:
    n = [F.regexp_count(F.col(c), F.lit(pattern)) for c in columns]
    return sum(n[1:], n[0])


def bm25_search(
    df: DataFrame,
    query: str,
    columns: list[str],
    key: str,
    mode: str = "all",
    limit: int = 50,
    offset: int = 0,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """Best matching rows by BM25; lower ``rank`` is better.

    Modes: ``all`` terms, ``any`` term, one ``phrase``, or ``prefix`` (the last term may continue).
    Length counts the tokens of all columns. Term counts are taken row by row, so only one row of
    totals (documents, tokens, documents per term) is shuffled and sent back to all tasks.
    """
    terms = [w for w in _query_tokens(query) if w]
    phrases = [terms] if mode == "phrase" else [[w] for w in dict.fromkeys(terms)]
    if not phrases or not phrases[0]:
        return df.select(key).limit(0).withColumn("rank", F.lit(0.0))
    per_column = [f"_t{i}" for i in range(len(columns))]
    rows = df.select(key, *[_folded(F.col(c)).alias(t) for c, t in zip(columns, per_column)])
    size = _count_all(per_column, f"{LETTER}+")
    tf = []
    for i, p in enumerate(phrases):
        last = mode == "prefix" and i == len(phrases) - 1
        tf.append(_count_all(per_column, _pattern(p, last)))
    names = [f"tf{i}" for i in range(len(phrases))]
    counted = rows.select(key, size.alias("dl"), *[c.alias(n) for c, n in zip(tf, names)])
    totals = counted.agg(
        F.count("*").alias("_n"),
        F.avg("dl").alias("_avg"),
        *[F.count_if(F.col(n) > 0).alias(f"_d{n}") for n in names],
    )
    return _ranked(counted.join(F.broadcast(totals)), key, names, mode, limit, offset, k1, b)


def _term_score(f: Column, d: Column, dl: Column, n: Column, avg: Column, k1: float, b: float) -> Column:
    """Share of one term in the score of a row with ``f`` occurrences; ``d`` of ``n`` rows have the term."""
    idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(1e-6))
    return idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avg))


def _ranked(
    counted: DataFrame, key: str, names: list[str], mode: str, limit: int, offset: int, k1: float, b: float
) -> DataFrame:
    """Best rows of (key, dl, term counts ``names``, ``_n``, ``_avg``, and ``_d`` + name for each count)."""
    has = [F.col(n) > 0 for n in names]
    cond = has[0]
    for h in has[1:]:
        cond = (cond | h) if mode == "any" else (cond & h)
    score = F.lit(0.0)
    for n in names:
        score = score + _term_score(F.col(n), F.col(f"_d{n}"), F.col("dl"), F.col("_n"), F.col("_avg"), k1, b)
    ranked = counted.filter(cond).select(key, (-score).alias("rank")).orderBy("rank", key)
    return (ranked.offset(offset) if offset else ranked).limit(limit)


def _query_tokens(query: str) -> list[str]:
    from palaver.functions.text import FOLD_FROM, FOLD_TO

    low = query.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return "".join(c if c.isalnum() else " " for c in low).split()
