"""Source metadata beside, or in, the text of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import joined_hash
from millrace.functions.text import estimate_tokens

_CHUNK = ("chunk_id", "partition_key", "chunk_seq", "source_rows", "n_source_rows")


def attach_metadata(chunks: DataFrame, metadata: DataFrame, key: str, columns: Sequence[str], *, in_text: bool = False) -> DataFrame:
    """Chunks with ``columns`` of their partition's metadata, the token estimate and a content hash.

    Defined cases: metadata rows that agree collapse to one; rows that conflict each give a copy of the chunk
    (a failed uniqueness check, never a silent choice); chunks without metadata keep nulls; keys are compared
    as text; null keys match nothing; ``in_text`` sets ``column: value`` lines, null as empty, before the text;
    metadata columns named like a chunk column are refused. The join is left to the optimizer: it broadcasts the metadata only within its size threshold.
    """
    if not columns:
        raise ValueError("attach_metadata: columns must not be empty")
    if clash := set(columns) & {*_CHUNK, "chunk_text", "token_estimate", "content_hash"}:
        raise ValueError(f"attach_metadata: columns {sorted(clash)} are already a chunk's")
    meta = metadata.select(F.col(key).cast("string").alias("__key"), *columns).distinct()
    joined = chunks.select(*_CHUNK, "chunk_text").join(meta, F.col("partition_key").cast("string") == F.col("__key"), "left")
    if in_text:
        head: list[Column] = []
        for c in columns:
            head += [F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n")]
        joined = joined.withColumn("chunk_text", F.concat(*head, F.lit("---\n"), "chunk_text"))
    return joined.select(
        "chunk_id", "partition_key", "chunk_seq", "source_rows", "chunk_text", "n_source_rows", estimate_tokens("chunk_text").alias("token_estimate"), *columns, joined_hash("chunk_text", *columns).alias("content_hash")
    )


def dependency_violations(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, variants) of keys with more than one combination of ``columns``, null being a value."""
    return rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)]).distinct().groupBy("key").agg(F.count("*").alias("variants")).filter("variants > 1")
