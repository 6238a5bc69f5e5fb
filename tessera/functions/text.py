"""Column helpers over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dotted numbers are one token; otherwise runs of letters, digits and underscores of any script (fixed value).
TOKEN = r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}_]+"
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"))


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text, none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """text without white space around it (trim() only drops blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """A key for comparison without case; differs from full case folding only in letters such as ß."""
    return F.lower(text)


def unquote(text: Column) -> Column:
    """text without one layer of paired quotes."""
    out = text
    for a, b in QUOTES:
        wrapped = (F.length(text) >= 2) & text.startswith(a) & text.endswith(b)
        out = F.when(wrapped, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(out)
    return out


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunk_id(source: Column, text: Column) -> Column:
    """The content address of a chunk: 16 hex digits of SHA-256 over source, a zero byte and text."""
    return F.substring(F.sha2(F.concat(source, F.lit("\0"), text), 256), 1, 16)
