"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Lower case, ASCII letters and digits only (letters with accents fall away)."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def plain_similarity(x: Column, y: Column) -> Column:
    """100 less the share of edits between two plain names; 0 where one is null, 100 where both are equal."""
    longest = F.greatest(F.length(x), F.length(y))
    share = (longest - F.levenshtein(x, y)) / F.greatest(longest, F.lit(1)) * 100
    return F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 100.0).otherwise(share)


def similarity_percent(a: Column, b: Column) -> Column:
    """The same of two names as typed; 0 where one is null or empty."""
    named = lambda c: F.when(F.length(c) > 0, plain_name(c))
    return plain_similarity(named(a), named(b))


def csv_quoted(value: Column) -> Column:
    """In double quotes, those inside doubled; null as an empty pair."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def joined(items: Column) -> Column:
    """Entries that are not null, with "; " between them; empty for a null array."""
    return F.coalesce(F.array_join(items, "; "), F.lit(""))


def line_key(line: Column) -> Column:
    """What makes two lines the same: no outer blanks, no case, single blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"(?U)\s+", " "))), " +", " ")


def url_file_name(url: Column, otherwise: str = "unknown.jpg") -> Column:
    """The last part of a URL or path."""
    return F.coalesce(F.nullif(F.substring_index(url, "/", -1), F.lit("")), F.lit(otherwise))


def without_code_fence(text: Column) -> Column:
    """A text without the code fence that a model put around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def text_around(text: Column, needle: str, reach: int = 80) -> Column:
    """Up to ``reach`` characters either side of the first find, any case; null where there is none."""
    at = F.instr(F.lower(text), needle.lower())
    first = F.greatest(F.lit(1), at - reach)
    last = F.least(F.length(text), at + len(needle) + reach - 1)
    return F.when(at > 0, F.regexp_replace(F.substring(text, first, last - first + 1), r"\s+", " "))


def content_hash(value: Column) -> Column:
    """SHA-256 in hexadecimal digits, the name of a file stored by its content."""
    return F.sha2(value, 256)


def path_of(stored: Column, root: str = "uploads") -> Column:
    """A stored path as a path below ``root``: absolute, already below it, or a bare name."""
    return F.when(stored.startswith("/") | stored.startswith(f"{root}/"), stored).otherwise(F.concat(F.lit(f"{root}/"), stored))
