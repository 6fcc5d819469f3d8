"""Identifier text, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One whole number as tools write it: leading zeros, a decimal part of zeros, a label before it.
_NUMBER = r"(\d+)(?:\.0*(?![0-9]))?"


def whole_number(text: Column) -> Column:
    """The whole number a text stands for, null where it holds none (or one beyond 18 digits)."""
    digits = F.regexp_extract(text, _NUMBER, 1)
    trimmed = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when((F.length(digits) > 0) & (F.length(trimmed) <= 18), trimmed.cast("bigint"))


def whole_numbers(text: Column) -> Column:
    """Distinct whole numbers of a delimited text, null or empty text giving an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), F.lit(1))
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))
    kept = F.filter(trimmed, lambda x: F.length(x) <= 18)
    return F.array_distinct(F.transform(kept, lambda x: x.cast("bigint")))


def term_key(text: Column) -> Column:
    """Term ids are the same after trimming and upper-casing; empty ones are null."""
    key = F.upper(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""))
    return F.when(F.length(key) > 0, key)
