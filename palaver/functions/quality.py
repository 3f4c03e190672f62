"""Transcript quality: leaks, media artifacts, repetition, fillers, language policy, status."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.text import contains_any, let, trim_ws, words

# Phrases that mark a transcript of played media.
MEDIA_SIGNATURES = (
    "thank you", "gracias", "merci", "danke", "спасибо", "谢谢", "terima kasih", "สวัสดี",
    "ধন্যবাদ", "شكرا", "god bless", "god bless you", "amen", "subtitle", "subtitles", "字幕",
    "字幕组", "субтитры", "community", "amara", "addic7ed", "opensubtitles", "created by",
    "made by", "synced by", "corrected by", "subscribe", "subscription", "ดูเพิ่มเติม",
    "thanks for watching", "thank you for watching", "please subscribe", "like and subscribe",
    "follow me on", "check out my", "enjoy the video", "enjoy", "see you next time", "goodbye",
    "bye bye", "see you", "अलविदा", "directed by", "produced by", "music by", "okay", "ok",
    "yeah", "yep", "nope",
)
# Prompt phrases; the first names the two speakers, here as parameters.
PROMPT_PATTERNS = (
    "owner, partner",
    "use only hindi and english",
    "do not output any other language",
)
# Phrases that flag a stored conversation or a transcript for review.
REVIEW_SIGNATURES = (
    "thanks for watching",
    "amara.org",
    "use only hindi and english",
    "do not output any other language",
)
# Words that carry no content.
FILLERS = ("um", "uh", "ah", "hmm", "mm", "ha", "heh")
# Accepted language labels.
LANGUAGES = ("hi", "hindi", "en", "english", "")
# Tokens that mark Hindi in Latin script.
HINDI_TOKENS = (
    "hai", "ka", "ki", "se", "mein", "aur", "kya", "nahi", "ho", "ke", "ko", "bhi", "ye", "thi",
)
# A compact phrase and the names that must also appear for a prompt echo.
ECHO_RULES = (
    ("hindiandenglish", ("owner", "partner")),
    ("आजकीबातचीत", ("partner",)),
)

#: Letters of the ends of two words by which a phrase is looked up.
_ENDS = 3
#: Letters read a word up to which phrases are searched without looking up their ends.
_SEARCHED = 4000

FOREIGN_SCRIPT = r"[\p{L}\p{M}&&[^\p{IsLatin}\x{0900}-\x{097F}\x{200C}\x{200D}]]"


def normal(text: Column) -> Column:
    return F.lower(trim_ws(text))


def prompt_leak(text: Column, patterns=PROMPT_PATTERNS) -> Column:
    return contains_any(normal(text), patterns)


def media_artifact(text: Column, signatures=MEDIA_SIGNATURES, word_boundary: bool = False) -> Column:
    """The text ends with a signature. ``word_boundary`` spares words such as "book"."""
    low = normal(text)
    out = F.lit(False)
    for s in dict.fromkeys(signatures):
        hit = F.endswith(low, F.lit(s))
        if word_boundary:
            hit = (low == s) | (hit & F.endswith(low, F.lit(" " + s)))
        out = out | hit
    return out


def _repeated(tokens: Column, times: int) -> Column:
    """Distinct tokens longer than two characters that occur ``times`` or more: equal neighbours
    at that distance once sorted, so the cost stays n log n on long texts."""
    far = times - 1

    def hits(s):
        n = F.greatest(F.size(s) - far, F.lit(0))
        pairs = F.zip_with(
            F.slice(s, F.lit(1), n), F.slice(s, F.lit(1 + far), n), lambda a, b: F.when(a == b, a)
        )
        return F.array_distinct(F.array_compact(pairs))

    return let(F.sort_array(F.filter(tokens, lambda w: F.length(w) > 2)), hits)


def repetitive_word(text: Column, times: int = 3) -> Column:
    """First word of the text that occurs ``times`` or more, else null."""

    def first(toks):
        at = F.transform(
            _repeated(toks, times),
            lambda r: F.struct(F.array_position(toks, r).alias("p"), r.alias("w")),
        )
        return F.when(F.size(toks) >= 3, F.array_min(at)["w"])

    return let(words(normal(text)), first)


def repetitive_words(text: Column, times: int = 3) -> Column:
    return repetitive_word(text, times).isNotNull()


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a phrase."""
    cut = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return (cut / F.length(phrase)).cast("bigint")


def first_repeated_phrase(low: str, times: int) -> str | None:
    """First two-word phrase of a trimmed lower-case text, not among the last two starts, found ``times`` or more.

    A phrase also counts where it ends and begins inside longer words. Pairs of whole words that occur often enough
    settle all that comes after them; of the phrases before, a long text is searched only for those whose ends meet
    often enough.
    """
    toks = low.split()
    n = len(toks) - 3
    if n <= 0:
        return None
    pairs = list(zip(toks, toks[1:], strict=False))
    often = Counter(pairs)
    stop = next((i for i in range(n) if often[pairs[i]] >= times and low.count(" ".join(pairs[i])) >= times), n)
    first = dict.fromkeys(pairs[:stop])
    if len(first) * len(low) > _SEARCHED * n:
        ends: Counter = Counter()
        for left, right in pairs:
            befores = [left[-i:] for i in range(1, min(len(left), _ENDS) + 1)]
            afters = [right[:i] for i in range(1, min(len(right), _ENDS) + 1)]
            ends.update([(x, y) for x in befores for y in afters])
        first = [(a, b) for a, b in first if ends[a[-_ENDS:], b[:_ENDS]] >= times]
    for a, b in first:
        if low.count(f"{a} {b}") >= times:
            return f"{a} {b}"
    return " ".join(pairs[stop]) if stop < n else None


@F.pandas_udf(T.StringType())
def _repeated_phrase(low: pd.Series, times: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else first_repeated_phrase(s, k) for s, k in zip(low, times, strict=True)], dtype=object)


def repetitive_phrase(text: Column, times: int = 3) -> Column:
    """First two-word phrase, not among the last two starts, found ``times`` or more, else null."""
    return _repeated_phrase(normal(text), F.lit(times))


def too_short_filler(text: Column, n_words: Column, min_words: int = 3) -> Column:
    fillers = F.array(*[F.lit(f) for f in FILLERS])
    only = F.size(F.array_except(words(normal(text)), fillers)) == 0
    return (n_words < min_words) & (only | (n_words == 0))


@F.pandas_udf(T.DoubleType())
def _loop_cover(text: pd.Series, limit: pd.Series) -> pd.Series:
    """Share of the compact text that one repeated n-gram covers, where it exceeds the limit.

    A gram that covers more than the limit is made of characters that each occur as often as the
    gram. There are only a few such characters, so most texts are settled by character counts.
    """

    def cover(s: str, th: float) -> float:
        compact = "".join(s.split())
        n = len(compact)
        if n < 12:
            return 0.0
        counts = {c: compact.count(c) for c in set(compact)}
        top = max(counts.values())
        if top >= 8 and top / n > th:
            return top / n
        for size in (2, 3, 4):
            if top * size <= th * n:
                continue
            rare = {ord(c): " " for c, k in counts.items() if k * size <= th * n}
            runs = [r for r in compact.translate(rare).split(" ") if len(r) >= size]
            starts = sum(len(r) - size + 1 for r in runs)
            if starts < 5 or starts * size <= th * n:
                continue
            most = max(Counter(r[i : i + size] for r in runs for i in range(len(r) - size + 1)).values())
            if most >= 5 and most * size / n > th:
                return most * size / n
        return 0.0

    return pd.Series([cover(s or "", th) for s, th in zip(text, limit)], dtype="float64")


def repetition_loop(
    text: Column, threshold: float = 0.4, compression: Column | None = None
) -> Column:
    """A character n-gram (n up to 4) covers more than ``threshold`` of the compact text.

    With ``compression`` (the evaluation form) a ratio above 2.4 counts as well.
    """
    hit = _loop_cover(text, F.lit(threshold)) > threshold
    if compression is not None:
        hit = (F.trim(text) != "") & ((compression > 2.4) | hit)
    return hit


def language_policy(text: Column, language: Column) -> Column:
    """``unexpected_language``, ``unexpected_script`` or null."""
    return F.when(
        ~F.lower(F.coalesce(language, F.lit(""))).isin(list(LANGUAGES)), "unexpected_language"
    ).when(F.coalesce(text, F.lit("")).rlike(FOREIGN_SCRIPT), "unexpected_script")


def payload_text(text: Column, segments: Column | None = None, word_structs: Column | None = None):
    """All text of a payload in one string, for the policy test."""
    parts = [F.coalesce(text, F.lit(""))]
    if segments is not None:
        parts.append(F.array_join(F.transform(segments, lambda s: s["text"]), " "))
    if word_structs is not None:
        parts.append(F.array_join(F.transform(word_structs, lambda w: w["word"]), " "))
    return F.concat_ws(" ", *parts)


def prompt_echo(text: Column, rules=ECHO_RULES) -> Column:
    """The letters and digits of the text spell a prompt phrase together with a speaker name."""
    compact = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    out = F.lit(False)
    for phrase, names in rules:
        out = out | (F.contains(compact, F.lit(phrase)) & contains_any(compact, names))
    return out


def signature_flag(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), REVIEW_SIGNATURES)


def low_confidence(
    no_speech_prob: Column,
    avg_logprob: Column,
    max_no_speech: float = 0.6,
    min_logprob: float = -1.0,
) -> Column:
    return (no_speech_prob > max_no_speech) | (avg_logprob < min_logprob)


def mean_of(segments: Column, field: str) -> Column:
    """Mean of one field over an array of structs, 0 for an empty array."""
    total = F.aggregate(segments, F.lit(0.0), lambda a, s: a + F.coalesce(s[field], F.lit(0.0)))
    return F.when(F.size(segments) > 0, total / F.size(segments)).otherwise(F.lit(0.0))


def any_low_segment(
    segments: Column,
    max_no_speech: float = 0.6,
    min_logprob: float = -1.0,
    max_compression: float = 2.4,
) -> Column:
    """Some recognition segment is outside the confidence limits."""
    return F.exists(
        segments,
        lambda s: (F.coalesce(s["no_speech_prob"], F.lit(0.0)) > max_no_speech)
        | (F.coalesce(s["avg_logprob"], F.lit(0.0)) < min_logprob)
        | (F.coalesce(s["compression_ratio"], F.lit(0.0)) > max_compression),
    )


def assess_status(text: Column, language: Column, low: Column, loop: Column) -> Column:
    """Status of a transcript, from the strongest objection to none."""
    return (
        F.when(prompt_echo(text), "suspected_prompt_echo")
        .when(language_policy(text, language).isNotNull(), language_policy(text, language))
        .when(trim_ws(text) == "", "rejected_silence")
        .when(loop | (signature_flag(text) & low), "suspected_hallucination")
        .when(low, "low_confidence")
        .otherwise("ok")
    )


def contains_devanagari(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{097F}]")


def correct_language(text: Column, detected: Column, substring: bool = False) -> Column:
    """``ru`` without Cyrillic becomes ``hi`` or ``en``.

    ``substring`` is the live form: a Hindi token anywhere inside the text counts, and two of the
    tokens are not in its list.
    """
    low = F.lower(text)
    if substring:
        hindi = contains_any(low, [t for t in HINDI_TOKENS if t not in ("ye", "thi")])
    else:
        hindi = F.arrays_overlap(words(low), F.array(*[F.lit(t) for t in HINDI_TOKENS]))
    fixed = F.when(contains_devanagari(text) | hindi, "hi").otherwise("en")
    return F.when(
        (detected == "ru") & ~text.rlike(r"[\x{0400}-\x{04FF}]"), fixed
    ).otherwise(detected)


def plausible_cleanup(raw: Column, cleaned: Column, low: float = 0.25, high: float = 2.5) -> Column:
    """The cleaned text if it is not blank and of plausible length, else the raw text."""
    ratio = F.length(trim_ws(cleaned)) / F.greatest(F.length(trim_ws(raw)), F.lit(1))
    ok = (trim_ws(F.coalesce(cleaned, F.lit(""))) != "") & ratio.between(low, high)
    return F.when(ok, trim_ws(cleaned)).otherwise(raw)
