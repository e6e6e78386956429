"""Text expressions: token estimates, normalisation, ordered arrays and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text: Column | str) -> Column:
    """Four characters a token, rounded up, as a long; null for null."""
    return F.expr("cast(0 as bigint)") + F.ceil(F.length(col(text)) / 4).cast("long")


def collapse_ws(text: Column | str) -> Column:
    """Outer blanks off, then every run of white space as one blank. The class is spelled out: engines differ on ``\\s``."""
    return F.regexp_replace(F.trim(col(text)), r"[\t\n\f\r ]+", " ")


def norm_text(text: Column | str, *, ignore_case: bool = True, normalize_whitespace: bool = True) -> Column:
    c = collapse_ws(text) if normalize_whitespace else col(text)
    return F.lower(c) if ignore_case else c


def contains(haystack: Column | str, needle: Column | str) -> Column:
    """Case-sensitive containment; null if either is null."""
    return F.contains(col(haystack), col(needle))


def ordered(value: Column | str, order: Column | str) -> Column:
    """Aggregate: the values in order, null order keys last, ties by value."""
    o, v = col(order), col(value)
    rows = F.array_sort(F.collect_list(F.struct(o.isNull().alias("n"), o.alias("o"), v.alias("v"))))
    return F.transform(rows, lambda r: r.v)


def ordered_text(value: Column | str, separator: str, order: Column | str) -> Column:
    """Aggregate: the texts in order, joined; empty texts keep their separators, null ones are left out."""
    return F.array_join(F.filter(ordered(value, order), lambda v: v.isNotNull()), separator)


def utc_now() -> Column:
    """The moment of the query, in UTC, without a zone."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
