"""Romanisation, match keys and term tests for mixed Devanagari and Latin text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import let, squeeze, trim_ws

# Devanagari signs and their simple Latin spelling; the virama maps to nothing.
ROMAN = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ए": "e", "ऐ": "ai",
    "ओ": "o", "औ": "au", "ं": "n", "ः": "h", "्": "",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
    "ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "े": "e", "ै": "ai", "ो": "o",
    "ौ": "au", "ृ": "ri",
}
# Latin letters with marks and their plain spelling in match keys.
PLAIN = {
    "ā": "a", "ī": "i", "ū": "u", "ṛ": "ri", "ṇ": "n", "ṭ": "t", "ḍ": "d", "ṅ": "n", "ñ": "n",
    "ś": "sh", "ṣ": "sh", "ḥ": "h",
}
# Everyday words that never enter the glossary, in both scripts.
COMMON_WORDS = (
    "यार", "yaar", "मतलब", "matlab", "अच्छा", "accha", "achha", "ठीक", "theek", "हाँ", "haan",
    "नहीं", "nahi", "na", "क्या", "kya", "कैसे", "kaise", "कब", "kab", "कहाँ", "kahan", "कौन",
    "kaun", "क्यों", "kyun", "kyon", "कितना", "kitna", "बहुत", "bahut", "थोड़ा", "thoda", "ज़रा",
    "zara", "अभी", "abhi", "फिर", "phir", "लेकिन", "lekin", "par", "और", "aur", "या", "ya",
    "इसलिए", "isliye", "वाला", "wala", "vala", "वाली", "wali", "vali", "ज़रूर", "zaroor", "शायद",
    "shayad", "जल्दी", "jaldi", "देर", "der", "समझ", "samajh", "देख", "dekh", "सुन", "sun", "बोल",
    "bol", "आजा", "aaja", "जा", "ja", "खा", "kha", "पी", "pi", "रहा", "raha", "रही", "rahi", "है",
    "hai", "हैं", "hain", "था", "tha", "थी", "thi", "होगा", "hoga", "होगी", "hogi", "सकता", "sakta",
    "सकती", "sakti", "चाहिए", "chahiye", "पता", "pata", "ओके", "oke", "ok", "एक", "ek", "दो", "do",
    "तीन", "teen",
)

DEVANAGARI_RUN = r"([\x{0900}-\x{097F}]+)"
# Short Latin words; the boundaries are spelled out because engines differ on what a word is.
SHORT_WORD = r"(?=[a-z])(?<![\p{L}\p{M}\p{N}_])([a-z]{2,6})(?![\p{L}\p{M}\p{N}_])"


def _one_by_one(col: Column, mapping: dict[str, str]) -> Column:
    single = {k: v for k, v in mapping.items() if len(v) <= 1}
    dropped = "".join(k for k, v in single.items() if not v)
    kept = {k: v for k, v in single.items() if v}
    # ``translate`` deletes characters that have no partner, so the dropped ones come last.
    out = F.translate(col, "".join(kept) + dropped, "".join(kept.values()))
    for k, v in mapping.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def romanize(col: Column) -> Column:
    """Devanagari spelled in Latin letters sign by sign; other characters stay."""
    return F.when(col.rlike(r"[\x{0900}-\x{097F}]"), _one_by_one(col, ROMAN)).otherwise(col)


def match_key(col: Column) -> Column:
    """Key under which spellings of one term meet: Latin, lower case, plain letters."""
    low = trim_ws(F.lower(romanize(col)))
    return squeeze(F.when(low.rlike(r"[^\x{00}-\x{7F}]"), _one_by_one(low, PLAIN)).otherwise(low))


def is_common(term: Column, words=COMMON_WORDS) -> Column:
    return trim_ws(F.lower(term)).isin(list(words)) | match_key(term).isin(list(words))


def potential_terms(text: Column) -> Column:
    """Devanagari runs, then short Latin words, of a text."""
    return F.concat(
        F.regexp_extract_all(text, F.lit(DEVANAGARI_RUN), F.lit(1)),
        F.regexp_extract_all(F.lower(text), F.lit(SHORT_WORD), F.lit(1)),
    )


def is_valid_term(term: Column) -> Column:
    """Two or more characters, none three times in a row and none more than half of all."""
    top = let(
        F.split(term, ""),
        lambda cs: F.array_max(
            F.transform(F.array_distinct(cs), lambda c: F.size(F.filter(cs, lambda d: d == c)))
        ),
    )
    return (F.length(term) >= 2) & ~term.rlike(r"(?s)(.)\1{2,}") & (top <= F.length(term) * 0.5)
