"""Vector expressions, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null if a vector is null, empty or of length zero; unequal dimensions raise."""
    a, b = col(a), col(b)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.try_divide(_dot(a, b), F.nullif(norm, F.lit(0.0)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("cosine: vectors of unequal dimension")).cast("double")).otherwise(value)


def embedding_dimension(vector: Column | str) -> Column:
    """Observed length of a vector; null for null."""
    v = col(vector)
    return F.when(v.isNotNull(), F.size(v))


def vector_to_json(vector: Column | str) -> Column:
    return F.to_json(col(vector))


def json_to_vector(text: Column | str) -> Column:
    return F.from_json(col(text), "array<double>")


def json_cosine(vector: Column | str, text: Column | str) -> Column:
    """Cosine of a vector and one written as a JSON array."""
    return cosine(vector, json_to_vector(text))
