"""Deterministic checks of what models returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.prompts import schema_enum
from millrace.functions.text import contains, norm_text


def ungrounded(rows: DataFrame, evidence: str, source: str, *, ignore_case: bool = True, normalize_whitespace: bool = True, strict: bool = False) -> DataFrame:
    """(_evidence, _source) where the evidence is blank or does not stand in the source.

    A null evidence is blank; a null source is no violation unless ``strict``.
    """
    kw = {"ignore_case": ignore_case, "normalize_whitespace": normalize_whitespace}
    e = norm_text(evidence, **kw)
    bad = e.isNull() | (F.trim(e) == "") | ~contains(norm_text(source, **kw), e)
    bad = F.coalesce(bad, F.lit(strict))
    return rows.filter(bad).select(F.col(evidence).alias("_evidence"), F.col(source).alias("_source"))


def nonconforming(rows: DataFrame, column: str, schema: str, *, name: str | None = None, allow_null: bool = False) -> DataFrame:
    """(_value) outside the schema's allowed values; null is a violation unless allowed."""
    c = F.col(column)
    bad = ~c.isin(schema_enum(schema, name))
    bad = F.coalesce(bad, F.lit(not allow_null))
    return rows.filter(bad).select(c.alias("_value"))


def evaluate(rows: DataFrame, prediction: str, expected: str, *, prompt_version: str | None = None) -> DataFrame:
    """([prompt_version], metric, label, value): accuracy, and precision and recall of each label.

    Pairs are counted once, so the input is read once. A label never predicted has a null precision, one
    never expected a null recall; null labels count as rows of their own on either side; an empty input has
    one row, a null accuracy.
    """
    pairs = rows.groupBy(F.col(prediction).alias("p"), F.col(expected).alias("e")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("p") == F.col("e"), F.col("n")).otherwise(0)
    total = pairs.agg(F.sum(hit).cast("double").alias("h"), F.sum("n").alias("n")).select(F.lit("accuracy").alias("metric"), F.lit("__overall__").alias("label"), F.try_divide("h", "n").alias("value"))
    predicted = pairs.groupBy(F.col("p").alias("lp")).agg(F.sum("n").alias("pn"), F.sum(hit).alias("tp"))
    actual = pairs.groupBy(F.col("e").alias("la")).agg(F.sum("n").alias("an"))
    both = predicted.join(actual, F.col("lp") == F.col("la"), "full_outer").select(F.coalesce("lp", "la").alias("label"), F.coalesce("tp", F.lit(0)).cast("double").alias("tp"), "pn", "an")
    stacked = both.select("label", F.explode(F.array(F.struct(F.lit("precision").alias("metric"), F.try_divide("tp", "pn").alias("value")), F.struct(F.lit("recall").alias("metric"), F.try_divide("tp", "an").alias("value")))).alias("m"))
    out = total.unionByName(stacked.select("m.metric", "label", "m.value"))
    return out if prompt_version is None else out.select(F.lit(prompt_version).alias("prompt_version"), "metric", "label", "value")
