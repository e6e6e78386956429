"""One knowledge base of many sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import joined_hash
from millrace.operators.delta import delta

REQUIRED = ("relation", "source_type", "source_id", "account_key", "text", "embedding", "timestamp")


def _expr(value: str | Column) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def knowledge_base(sources: Sequence[Mapping[str, Any]], *, stored: DataFrame | None = None) -> DataFrame:
    """(source_type, source_id, account_key, text, embedding, ts, citation_url, classification, source_key, content_hash).

    Each source names a DataFrame (``relation``), a literal ``source_type`` and, as SQL expressions or columns,
    ``source_id, account_key, text, embedding, timestamp`` and perhaps ``citation_url, classification``.
    With ``stored`` only rows new or changed against it come out, source by source.

    Defined cases: a missing key raises; optional keys left out are null; dates become timestamps at midnight;
    embeddings are neither cast nor hashed, but their types must agree; null values hash as empty; a null
    source_id gives a null source_key; repeated rows stay.
    """
    if not sources:
        raise ValueError("knowledge_base: sources must not be empty")
    arms = []
    for n, s in enumerate(sources, 1):
        for k in REQUIRED:
            if k not in s:
                raise ValueError(f"knowledge_base: source {n} has no {k!r}")
        arm = s["relation"].select(
            F.lit(s["source_type"]).alias("source_type"),
            _expr(s["source_id"]).cast("string").alias("source_id"),
            _expr(s["account_key"]).cast("string").alias("account_key"),
            _expr(s["text"]).cast("string").alias("text"),
            _expr(s["embedding"]).alias("embedding"),
            _expr(s["timestamp"]).cast("timestamp_ntz").alias("ts"),
            *[(_expr(s[k]) if k in s else F.lit(None)).cast("string").alias(k) for k in ("citation_url", "classification")],
        )
        arm = arm.withColumn("source_key", F.concat("source_type", F.lit("::"), "source_id")).withColumn("content_hash", joined_hash("account_key", "text", "ts", "citation_url", "classification"))
        if arms and arm.schema["embedding"].dataType != arms[0].schema["embedding"].dataType:
            raise TypeError(f"knowledge_base: the embedding of source {n} is of another type")
        arms.append(arm if stored is None else delta(arm, stored, "source_key", "content_hash"))
    return reduce(DataFrame.unionByName, arms)
