"""The append-only log of model runs."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import utc_now
from millrace.operators.cost import batch_size
from millrace.plans.config import EngineConfig

FIELDS = (
    ("invocation_id", "string"),
    ("model_name", "string"),
    ("function_name", "string"),
    ("row_count", "int"),
    ("est_tokens", "decimal(38,9)"),
    ("est_cost", "decimal(38,9)"),
    ("run_at", "timestamp_ntz"),
    ("event", "string"),
    ("node_id", "string"),
)
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)


class RunLog:
    """One parquet folder; each event is a file of its own, so concurrent runs never conflict."""

    def __init__(self, spark: SparkSession, path: str, invocation_id: str | None = None) -> None:
        self.spark, self.path, self.invocation_id = spark, path, invocation_id or f"run-{uuid.uuid4().hex[:16]}"

    def bootstrap(self) -> None:
        """Create the log if it is missing; call once before any model runs."""
        self.spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All events; files of before a column existed read as null."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _append(self, **row) -> None:
        plain = ", ".join(f"{n} {'double' if t.startswith('decimal') else t}" for n, t in FIELDS)
        frame = self.spark.createDataFrame([[row.get(n) for n, _ in FIELDS]], plain).withColumn("run_at", utc_now())
        frame.select(*[F.col(n).cast(t) for n, t in FIELDS]).coalesce(1).write.mode("append").parquet(self.path)

    def started(self, function: str, model_name: str | None = None, batch: DataFrame | None = None, text: str | None = None, *, node_id: str | None = None, config: EngineConfig = EngineConfig(), prompt: str | None = None, **call) -> None:
        """Log the start with the batch's rows, tokens and cost, sized in one scan; without ``text`` the tokens are null."""
        if function in ("generate", "classify", "extract") and prompt is None:
            warnings.warn(f"{function} of {model_name} is logged without its prompt: tokens are understated", stacklevel=2)
        n, tokens = batch_size(batch, text, config=config, prompt=prompt, **call).first() if batch is not None else (None, None)
        cost = None if tokens is None or config.cost_per_1k_tokens is None else tokens / 1000.0 * config.cost_per_1k_tokens
        self._append(invocation_id=self.invocation_id, model_name=model_name, function_name=function, row_count=n, est_tokens=None if tokens is None else float(tokens), est_cost=cost, event="started", node_id=node_id)

    def completed(self, function: str, model_name: str | None = None, *, node_id: str | None = None) -> None:
        """Log success; never called for a run that failed."""
        self._append(invocation_id=self.invocation_id, model_name=model_name, function_name=function, event="completed", node_id=node_id)


def never_completed(log: DataFrame) -> DataFrame:
    """Started runs without a completed event of the same invocation, function, model and node."""
    keys = ["invocation_id", "function_name", "model_name", "node_id"]
    done = log.filter("event = 'completed'").select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return log.filter("event = 'started'").join(done, same[0] & same[1] & same[2] & same[3], "left_anti")
