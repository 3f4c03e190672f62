"""Deterministic identifiers from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id48(text: Column) -> Column:
    """First six bytes of the digest as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def hash_ids48(ids: Column) -> Column:
    """The same for a set of source ids, which are sorted and joined by line breaks first."""
    return hash_id48(F.array_join(F.sort_array(ids), "\n"))


def json_text(col: Column) -> Column:
    """A JSON string literal with only quotes, backslashes and control characters escaped."""
    out = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), out, F.lit('"'))


def csv_row_id(*fields: Column) -> Column:
    """``csv-`` and the digest of the fields as a JSON array with ``", "`` between them."""
    body = F.concat(F.lit("["), F.concat_ws(", ", *[json_text(f) for f in fields]), F.lit("]"))
    return F.concat(F.lit("csv-"), F.sha2(body, 256))
