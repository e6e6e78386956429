"""Models: a function of DataFrames and how its result is kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.ai import gates
from millrace.functions.prompts import PromptRegistry
from millrace.operators.cost import dev_sample, guard_agg_batch, guard_batch
from millrace.operators.delta import delta, version_guard
from millrace.plans.config import EngineConfig
from millrace.plans.runlog import RunLog
from millrace.plans.session import cut
from millrace.plans.state import StateTable


@dataclass
class Model:
    """``source`` gives the input rows, ``body`` makes the output of the rows to process.

    ``materialized``: view (a temporary view), table (rebuilt each run) or incremental (only new or changed
    rows by ``unique_key`` and ``hash_column``; matched keys are replaced; with a partition key as
    ``unique_key`` whole partitions are). ``pinned_version`` reprocesses everything when it changes.
    ``meta`` may name the prompt of the model's calls once (``ai_prompt``: name and version); it is then sized
    and logged with them and given to ``body`` as ``prompt`` and ``schema``. ``group_by`` is the group of ``ai_agg``.
    """

    name: str
    source: Callable[[SparkSession], DataFrame]
    body: Callable[..., DataFrame] = lambda rows, **_: rows
    materialized: str = "table"
    unique_key: str | None = None
    hash_column: str | None = None
    full_refresh: bool | None = None
    pinned_version: str | None = None
    version_column: str = "model_version"
    function: str | None = None
    text: str | None = None
    group_by: str | None = None
    call: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)


class Runner:
    """Runs models against snapshots under ``root``, logging model calls.

    The rows to process are found once and, where a model is called or rows are merged, written (a checkpoint);
    guard, log and body all read that one set. The order is gates, delta, sample, guard, started, body,
    snapshot, completed: a failure leaves the last snapshot in force and no completed event. Without ``log``
    the events go to ``run_log_path``, if that is set. ``keep_old`` leaves superseded versions to readers.
    """

    def __init__(
        self, spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), log: RunLog | None = None, *, prompts: PromptRegistry | None = None, buckets: int = 64, keep_old: bool = True
    ) -> None:
        self.spark, self.root, self.config, self.prompts, self.buckets, self.keep_old = spark, root, config, prompts, buckets, keep_old
        if log is None and config.run_log_path:
            log = RunLog(spark, config.run_log_path)
            log.bootstrap()
        self.log = log
        self.ran: dict[str, int] = {}

    def table(self, name: str, key: str | None = None) -> StateTable:
        return StateTable(self.spark, self.root, name, key, self.buckets)

    def prompt_of(self, model: Model) -> dict[str, Any]:
        """The prompt and schema that the model's meta names; empty if it names none."""
        if not model.meta.get("ai_prompt"):
            return {}
        if self.prompts is None:
            raise ValueError(f"{model.name}: names a prompt, but the runner has no prompts")
        prompt, schema = self.prompts.resolve(None, None, model.meta)
        return {"prompt": prompt, "schema": schema}

    def run(self, model: Model, *, full_refresh: bool = False) -> DataFrame:
        if model.function:
            gates.require_enabled(model.function, self.config)
            gates.require_safe_materialization(model.function, model.materialized)
            gates.require_full_refresh_gate(model.function, model.materialized, model.full_refresh)
        rows, asked = model.source(self.spark), self.prompt_of(model)
        if model.materialized == "view":
            out = model.body(rows, **asked)
            out.createOrReplaceTempView(model.name)
            return out
        if model.materialized not in ("table", "incremental"):
            raise ValueError(f"{model.name}: unknown materialization {model.materialized!r}")
        incremental = model.materialized == "incremental"
        if incremental and not model.unique_key:
            raise ValueError(f"{model.name}: an incremental model needs unique_key")
        table, stored = self.table(model.name, model.unique_key if incremental else None), None
        if incremental:
            refresh = full_refresh if model.full_refresh is None else model.full_refresh
            if table.version() is not None:
                gates.require_reembed_allowed(model.function or "", refresh, self.config)
            stored = None if refresh else table.read()
        everything = stored is None or (model.pinned_version is not None and version_guard(stored, model.pinned_version, model.version_column))
        batch = rows if everything else delta(rows, stored, model.unique_key, model.hash_column)
        if model.function:
            batch = self._guarded(model, cut(dev_sample(batch, self.config.ai_sample_rows)), {**asked, **model.call})
        if stored is None:
            out = table.write(model.body(batch, **asked))
            self.ran[model.name] = (batch if model.function else out).count()
        else:
            made = cut(model.body(batch, **asked))  # model calls are not made again for the merge
            self.ran[model.name] = (batch if model.function else made).count()
            out = table.merge(made)
        if not self.keep_old:
            table.drop_old()
        if model.function and self.log:
            self.log.completed(model.function, model.name, node_id=f"model.{model.name}")
        return out

    def _guarded(self, model: Model, batch: DataFrame, call: dict[str, Any]) -> DataFrame:
        """``batch``, within its ceilings and logged as started."""
        guard_batch(batch, model.text, config=self.config, **call)
        if model.function == "ai_agg":
            guard_agg_batch(batch, model.text, model.group_by, config=self.config)
        if self.log:
            self.log.started(model.function, model.name, batch, model.text, node_id=f"model.{model.name}", config=self.config, **call)
        return batch

    def teardown(self, names: list[str], *, dry_run: bool = True) -> list[str]:
        """Drop the named models' tables; by default only say which."""
        there = [n for n in names if self.table(n).version() is not None]
        if not dry_run:
            for n in there:
                self.table(n).drop()
        return there
