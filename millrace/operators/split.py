"""The plain sentence rule: a run of other characters and the marks ``.!?`` that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern of a sentence.
SENTENCE = "[^.!?]+[.!?]*"


def split_sentences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(sentence_id, document_id, sentence_index, sentence_text); the index counts from 1.

    Defined cases: blank pieces are dropped after the index is given, so indexes may have gaps; null texts
    have no sentences; a null id gives null sentence ids; repeated rows give their sentences again. Decimals
    and abbreviations are cut: the rule knows no language.
    """
    pieces = docs.select(F.col(id_column).alias("document_id"), F.posexplode(F.regexp_extract_all(F.col(text_column), F.lit(SENTENCE), F.lit(0))).alias("p", "t"))
    index = (F.col("p") + 1).cast("long")
    return pieces.withColumn("sentence_text", F.trim("t")).filter("sentence_text <> ''").select(
        F.concat(F.col("document_id").cast("string"), F.lit("-"), index.cast("string")).alias("sentence_id"), "document_id", index.alias("sentence_index"), "sentence_text"
    )
