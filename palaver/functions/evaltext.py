"""Text normalisation and edit distances for accuracy scoring."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.romanize import romanize
from palaver.functions.text import words

# Canonical words and their variants, in the order they apply; later entries win.
VARIANTS = (
    ("hai", "hai hain"), ("nahi", "nahin nahi nahiin naheen"), ("ho", "hoo"), ("ka", "kaa ka"),
    ("ki", "kee ki"), ("se", "say se"), ("mein", "me main mein"), ("aur", "or aur"),
    ("kya", "kya kia"), ("ke", "kay ke"), ("ko", "ko"), ("bhi", "bhee bhi"), ("ye", "yeh ye"),
    ("wo", "woh wo"), ("tha", "thaa tha"), ("thi", "thee thi"), ("the", "thee the"),
    ("kar", "kr kar"), ("karna", "krna karna"), ("hum", "hm hum"), ("tum", "tm tum"),
    ("mera", "mera meraa"), ("tera", "tera teraa"), ("uska", "uska uskaa"), ("iska", "iska iskaa"),
    ("kyun", "kyu kyun q"), ("kaise", "kaise kesay"), ("kahan", "kahan kha"), ("kab", "kb kab"),
    ("kon", "kaun kon"), ("kitna", "kitna ktna"), ("accha", "achha acha accha acchaa"),
    ("theek", "thik theek thk"), ("bas", "bs bas"), ("abhi", "abi abhi"), ("pehle", "pehle phle"),
    ("baad", "bad baad baadmein"), ("kal", "kl kal"), ("aaj", "aj aaj"), ("subah", "subha subah"),
    ("shaam", "sham shaam"), ("raat", "rat raat"), ("din", "dn din"), ("hafta", "hfta hafta"),
    ("mahina", "mhina mahina mahena"), ("saal", "sal saal"), ("ghar", "ghr ghar"),
    ("office", "ofis office offis"), ("meeting", "miting meeting mitng"), ("call", "cl call"),
    ("message", "msg mesg message"), ("docker", "dokar docker"),
    ("tailscale", "telskel tailscale tailscal"), ("deployment", "deploi deployment deploy"),
    ("server", "sarvar server"), ("database", "databes database db"), ("config", "confg config cnfg"),
    ("script", "skript script"), ("code", "kod code"), ("bug", "bg bug"), ("fix", "fik fix"),
    ("error", "eror error err"), ("problem", "prblm problem prob"), ("solution", "solushn solution sol"),
    ("test", "tst test"), ("run", "rn run"), ("build", "bild build"), ("deploy", "deplo deploy"),
    ("push", "psh push"), ("pull", "pl pull"), ("commit", "comit commit"), ("branch", "branch brnch"),
    ("merge", "merj merge"), ("review", "revu review"), ("approve", "aprov approve"),
    ("reject", "rejkt reject"),
)
# Spoken forms of the numbers 0 to 20.
NUMBERS = (
    "zero ek do teen chaar paanch che saat aath nau das gyarah barah terah chaudah pandrah solah "
    "satrah atharah unnis bees"
).split()
# Characters that become spaces.
PUNCTUATION = r"[।.,?!;:'\"()\[\]{}\-—…*_+=~`@#$%^&\\|/<>]"


def variant_map(variants=VARIANTS) -> dict[str, str]:
    out: dict[str, str] = {}
    for canonical, forms in variants:
        out[canonical] = canonical
        for form in forms.split():
            out[form] = canonical
    return out


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed Unicode form. Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def composed(text: Column) -> Column:
    """``nfc`` of the texts that could change: all below U+0300 is composed already, so such rows
    go to Python as nulls and keep their text."""
    open_text = F.when(text.rlike(r"[^\x{00}-\x{2FF}]"), text)
    return F.coalesce(nfc(open_text), text)


def normalize_text(text: Column, compose: bool = True, variants=VARIANTS) -> Column:
    """Romanised lower-case words, small numbers spelled out, variants mapped to one form."""
    t = F.lower(romanize(composed(text) if compose else text))
    mapping = variant_map(variants)
    numbers = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBERS) for x in (str(i), w)])
    # Isolate standing numbers, then look each up; this is the word-boundary replacement.
    t = F.regexp_replace(t, r"(?=\d)(?<![\p{L}\p{M}\p{N}_])(\d{1,2})(?![\p{L}\p{M}\p{N}_])", "\u0001$1\u0001")
    spoken = F.transform(
        F.split(t, "\u0001"),
        lambda p: F.when(p.rlike(r"^\d{1,2}$"), F.coalesce(F.element_at(numbers, p), p)).otherwise(p),
    )
    t = F.array_join(spoken, "")
    t = F.regexp_replace(t, PUNCTUATION, " ")
    # A set test sends only the words that change to the map, which is searched in sequence.
    changed = {k: v for k, v in mapping.items() if k != v}
    known = F.create_map(*[F.lit(x) for kv in changed.items() for x in kv])
    fixed = F.transform(
        words(t), lambda w: F.when(w.isin(list(changed)), F.element_at(known, w)).otherwise(w)
    )
    return F.array_join(fixed, " ")


def error_rate(distance: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Edits per reference unit; an empty reference gives 1 if anything was said, else 0."""
    return (
        F.when((n_ref == 0) & (n_hyp == 0), 0.0)
        .when((n_ref == 0) | (n_hyp == 0), 1.0)
        .otherwise(distance / n_ref)
    )
