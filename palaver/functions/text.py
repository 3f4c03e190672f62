"""Text helpers with Unicode-aware whitespace, shared by every text operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace spelled out, for engines whose classes are ASCII only.
WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same set as one cheap test in Java patterns, and as plain characters for trimming.
SPACES = r"(?U)[\s\x{1C}-\x{1F}]+"
NON_SPACES = r"(?U)[^\s\x{1C}-\x{1F}]+"
WS_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A lambda that mentions an outer expression evaluates it again for every element; a lambda
    variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def trim_ws(col: Column) -> Column:
    """Only the ends are looked at, unlike with a pattern."""
    return F.trim(col, F.lit(WS_CHARS))


def words(col: Column) -> Column:
    """Tokens between runs of whitespace."""
    return F.regexp_extract_all(col, F.lit(NON_SPACES), F.lit(0))


def word_count(col: Column) -> Column:
    """Token count as bigint, without making the tokens."""
    return F.regexp_count(col, F.lit(NON_SPACES)).cast("bigint")


def words_payload_count(words_col: Column) -> Column:
    """Number of word structs whose text is not blank."""
    return F.size(F.filter(words_col, lambda w: trim_ws(w["word"]) != "")).cast("bigint")


def squeeze(col: Column) -> Column:
    return trim_ws(F.regexp_replace(col, SPACES, " "))


def contains_any(col: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(col, F.lit(n))
    return out


def like_any(cols: list[Column], needle: str, compat: bool = False) -> Column:
    """Case-insensitive substring in any column.

    With ``compat`` the wildcards ``%`` and ``_`` of the needle keep their LIKE meaning.
    """
    out = F.lit(False)
    for c in cols:
        low = F.lower(F.coalesce(c, F.lit("")))
        hit = low.like(f"%{needle.lower()}%") if compat else F.contains(low, F.lit(needle.lower()))
        out = out | hit
    return out


def preview(col: Column, length: int = 100) -> Column:
    return F.substring(col, 1, length)


def one_liner(col: Column, length: int = 80) -> Column:
    """First characters, with three dots when something was cut."""
    return F.concat(
        F.substring(col, 1, length), F.when(F.length(col) > length, "...").otherwise("")
    )


def truncate(col: Column, length: int) -> Column:
    """At most ``length`` characters, the last three being dots when cut."""
    return F.when(F.length(col) <= length, col).otherwise(
        F.concat(F.substring(col, 1, length - 3), F.lit("..."))
    )


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.when(n == 1, singular).otherwise(plural or singular + "s")


def strip_tags(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "<[^>]*>", ""))


def format_turn(start_us: Column, speaker: Column, text: Column) -> Column:
    """``[HH:MM:SS] Speaker: text`` with only the first letter of the speaker upper case."""
    from palaver.functions.timefmt import local_time

    name = F.concat(F.upper(F.substring(speaker, 1, 1)), F.lower(F.substring(speaker, 2, 10_000)))
    return F.concat(F.lit("["), local_time(start_us), F.lit("] "), name, F.lit(": "), text)


def compact_number(n: Column) -> Column:
    """``1.2M``, ``3.4K`` or the whole number itself; tenths round half up."""

    def tenths(unit: int) -> Column:
        v = F.floor((n + unit // 20) / F.lit(unit // 10)).cast("bigint")
        whole = F.floor(v / F.lit(10)).cast("string")
        return F.concat(whole, F.lit("."), F.pmod(v, F.lit(10)).cast("string"))

    return (
        F.when(n >= 1_000_000, F.concat(tenths(1_000_000), F.lit("M")))
        .when(n >= 1000, F.concat(tenths(1000), F.lit("K")))
        .otherwise(n.cast("string"))
    )


# Latin letters with marks and the plain letters that search folds them to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(col: Column) -> Column:
    return F.when(col.rlike(r"[^\x{00}-\x{7F}]"), F.translate(col, FOLD_FROM, FOLD_TO)).otherwise(col)


def slug(col: Column, max_length: int = 40, default: str = "conversation") -> Column:
    """Lower-case ASCII words joined by hyphens, at most ``max_length`` characters.

    Accented Latin letters fold to ASCII; other scripts are dropped, where a transliteration
    library would spell them out.
    """
    s = F.regexp_replace(fold_accents(F.lower(F.coalesce(col, F.lit("")))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, max_length), "-+$", "")
    return F.when(s == "", default).otherwise(s)


def voice_command(text: Column) -> tuple[Column, Column]:
    """(tag, captured text) of the first note, reminder or to-do command, else nulls."""
    # Command forms in the order they are tried.
    forms = [
        ("note", r"^note[:\s]+(.+)$"),
        ("note", r"^quick note[:\s]+(.+)$"),
        ("note", r"^add note[:\s]+(.+)$"),
        ("reminder", r"^reminder[:\s]+(.+)$"),
        ("reminder", r"^remind me (?:to )?(.+)$"),
        ("todo", r"^todo[:\s]+(.+)$"),
        ("todo", r"^to.do[:\s]+(.+)$"),
        ("todo", r"^add (?:a )?todo[:\s]+(.+)$"),
    ]
    low = F.lower(trim_ws(text))
    tag, captured = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(forms):
        hit = low.rlike(pattern)
        tag = F.when(hit, name).otherwise(tag)
        captured = F.when(hit, trim_ws(F.regexp_extract(low, pattern, 1))).otherwise(captured)
    return tag, captured


def extract_context(text: Column, term: Column, length: int = 50) -> Column:
    """Text around the first case-insensitive hit, cut to whole words at cut ends."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - 1 - length, F.lit(0))
    end = F.least(at - 1 + F.length(term) + length, F.length(text))
    raw = F.substring(text, start + 1, end - start)
    left = F.when(start > 0, F.substring(raw, F.instr(raw, " ") + 1, F.length(raw))).otherwise(raw)
    # A cut right end without any space loses its last character, as a reverse search of -1 does.
    back = F.instr(F.reverse(left), " ")
    right = F.when(
        end < F.length(text),
        F.substring(left, 1, F.length(left) - F.when(back > 0, back).otherwise(1)),
    ).otherwise(left)
    return F.when(at > 0, trim_ws(right)).otherwise("")


def strip_unintelligible(text: Column, marker: str = "[[UNINTELLIGIBLE]]") -> Column:
    """Join the lines of a reference text with spaces, without the marker lines."""
    return F.array_join(F.filter(F.split(trim_ws(text), "\n"), lambda x: x != marker), " ")


def speaker_name_valid(name: Column) -> Column:
    """1 to 48 letters, spaces, apostrophes or hyphens once spaces are collapsed."""
    n = squeeze(name)
    return (n != "") & (F.length(n) <= 48) & n.rlike(r"^[\p{L}\p{M} '\-]+$")


def canonical_name(name: Column) -> Column:
    return F.lower(squeeze(name))
