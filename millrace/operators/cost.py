"""What a batch of model calls would cost, and ceilings that stop it before any call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.prompts import prompt_overhead_chars
from millrace.functions.text import estimate_tokens
from millrace.plans.config import EngineConfig


class BatchCeilingExceeded(RuntimeError):
    """A batch is over a configured ceiling."""


def estimate_call_tokens(text: Column | str, *, prompt: str | None = None, schema: str | None = None, output_tokens: int | None = None, config: EngineConfig = EngineConfig()) -> Column:
    """Input tokens, plus those of the prompt and schema, plus an allowance for the reply.

    The allowance is ``output_tokens``, else ``est_output_tokens_per_row``, else ``max_output_tokens``, else 0.
    """
    reply = next((v for v in (output_tokens, config.est_output_tokens_per_row, config.max_output_tokens) if v is not None), 0)
    return estimate_tokens(text) + F.lit(-(-prompt_overhead_chars(prompt, schema) // 4) + reply).cast("long")


def batch_size(rows: DataFrame, text: str | None, *, where: Column | str | None = None, **call) -> DataFrame:
    """(n_rows, est_tokens) of a batch, in one scan."""
    some = rows if where is None else rows.filter(where)
    tokens = F.coalesce(F.sum(estimate_call_tokens(text, **call)), F.lit(0)) if text else F.lit(None)
    return some.agg(F.count("*").alias("n_rows"), tokens.cast("long").alias("est_tokens"))


def guard_batch(rows: DataFrame, text: str | None, *, where: Column | str | None = None, config: EngineConfig = EngineConfig(), **call) -> tuple[int, int]:
    """Rows and tokens of the batch; raises if either is over its ceiling (being equal passes)."""
    n, tokens = batch_size(rows, text, where=where, config=config, **call).first()
    if n > config.max_batch_rows or (tokens or 0) > config.max_est_tokens:
        raise BatchCeilingExceeded(f"batch exceeds ceiling: rows={n} (max_batch_rows={config.max_batch_rows}), est_tokens={tokens or 0} (max_est_tokens={config.max_est_tokens})")
    return n, tokens or 0


def oversized_groups(rows: DataFrame, text: str, group_by: str, *, max_tokens: int, where: Column | str | None = None) -> DataFrame:
    """(group_key, est_tokens) of groups over ``max_tokens``."""
    some = rows if where is None else rows.filter(where)
    return some.groupBy(F.col(group_by).alias("group_key")).agg(F.sum(estimate_tokens(text)).alias("est_tokens")).filter(F.col("est_tokens") > max_tokens)


def guard_agg_batch(rows: DataFrame, text: str, group_by: str, *, where: Column | str | None = None, config: EngineConfig = EngineConfig()) -> None:
    """Raises if a group is over ``max_agg_group_tokens``, naming the first five."""
    over = oversized_groups(rows, text, group_by, max_tokens=config.max_agg_group_tokens, where=where).orderBy(F.desc("est_tokens"), "group_key").limit(5).collect()
    if over:
        raise BatchCeilingExceeded("groups exceed max_agg_group_tokens: " + ", ".join(f"{r[0]} ({r[1]})" for r in over))


def dev_sample(rows: DataFrame, n: int | None) -> DataFrame:
    """``n`` random rows for development; all rows if ``n`` is None."""
    return rows if n is None else rows.orderBy(F.rand()).limit(n)
