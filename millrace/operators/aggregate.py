"""Group-level model calls: a group's texts in order become one input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ordered_text


def agg_inputs(rows: DataFrame, group_by: str, text: str, prompt: str, *, order: str | None = None) -> DataFrame:
    """(group_key, agg_input): the prompt, a blank line, and the group's texts joined by line breaks in order.

    Without ``order`` texts are in their own order, so that the input does not depend on the plan; null texts
    are left out, empty ones keep their line; a null group is a group. ``guard_agg_batch`` bounds a group's
    size before this collects it.
    """
    joined = ordered_text(text, "\n", order or text)
    return rows.groupBy(F.col(group_by).alias("group_key")).agg(F.concat(F.lit(prompt + "\n\n"), joined).alias("agg_input"))
