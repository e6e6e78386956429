"""Row-level and group-level model calls over a pluggable provider."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.ai import gates
from millrace.ai.provider import AiProvider, LocalProvider
from millrace.functions import prompts as P
from millrace.functions.text import col
from millrace.operators.aggregate import agg_inputs
from millrace.operators.cost import guard_agg_batch
from millrace.plans.config import EngineConfig
from millrace.plans.session import ship

_PROVIDERS: dict[str, AiProvider] = {"local": LocalProvider()}


def register_provider(name: str, provider: AiProvider) -> None:
    """Make a provider known by name."""
    _PROVIDERS[name] = provider


@dataclass
class AiFunctions:
    """The AI functions of one model: its settings, provider and materialisation.

    Every function first passes the gates. Calls go out in Arrow batches, equal inputs of a batch once. They
    are marked nondeterministic so that the optimizer does not repeat them; write their output before a second use.
    """

    config: EngineConfig = field(default_factory=EngineConfig)
    provider: str = "local"
    materialized: str | None = "table"
    full_refresh: bool | None = None

    def _gate(self, function: str) -> None:
        gates.require_enabled(function, self.config)
        gates.require_safe_materialization(function, self.materialized)
        gates.require_full_refresh_gate(function, self.materialized, self.full_refresh)
        if spark := SparkSession.getActiveSession():
            ship(spark)

    def embedder(self) -> AiProvider:
        """The provider that answers."""
        return _PROVIDERS[self.provider]

    def embed(self, text: Column | str, model: str | None = None) -> Column:
        """Vector of a text, array<float>; null for null."""
        self._gate("embed")
        model, provider = model or self.config.model_for("embed"), _PROVIDERS[self.provider]

        def call(texts: pd.Series) -> pd.Series:
            known = list(dict.fromkeys(t for t in texts if t is not None))
            vectors = dict(zip(known, provider.embed_batch(known, model)))
            return pd.Series([None if t is None else vectors[t] for t in texts])

        return F.pandas_udf(call, "array<float>").asNondeterministic()(col(text))

    def _complete(self, function: str, text: Column | str, prompt: str, schema: str | None, model: str | None, mode: str) -> Column:
        self._gate(function)
        model, provider = model or self.config.model_for(function), _PROVIDERS[self.provider]
        options = P.generation_params(self.config.max_output_tokens, self.config.thinking_budget)
        if schema is not None and not provider.structured:
            prompt = P.augment_prompt(prompt, schema) + P.shape_instruction(schema, mode)
        label = P.schema_label_field(schema) if mode == "label" else None

        def call(prompts: pd.Series) -> pd.Series:
            known = list(dict.fromkeys(p for p in prompts if p is not None))
            answers = dict(zip(known, provider.complete_batch(known, model, schema=schema, options=options)))
            out = [None if p is None else answers[p] for p in prompts]
            if label is not None:
                out = [None if a is None else (str(json.loads(a).get(label)) if a.lstrip().startswith("{") else a.strip()) for a in out]
            return pd.Series(out, dtype=object)

        return F.pandas_udf(call, "string").asNondeterministic()(P.render_prompt(prompt, text))

    def generate(self, text: Column | str, prompt: str, schema: str | None = None, model: str | None = None) -> Column:
        """Free text, or a JSON string if a schema is given."""
        return self._complete("generate", text, prompt, schema, model, "json")

    def classify(self, text: Column | str, prompt: str, schema: str, model: str | None = None) -> Column:
        """One label of the schema's first enum."""
        P.schema_enum(schema)
        return self._complete("classify", text, prompt, schema, model, "label")

    def extract(self, text: Column | str, prompt: str, schema: str, model: str | None = None) -> Column:
        """A JSON string with the schema's properties."""
        P.schema_struct(schema)
        return self._complete("extract", text, prompt, schema, model, "json")

    def ai_agg(self, rows: DataFrame, group_by: str, text: str, prompt: str, *, order: str | None = None, model: str | None = None) -> DataFrame:
        """(group_key, result): one call per group over its texts in order.

        A group over ``max_agg_group_tokens`` raises here, before any group is collected.
        """
        self._gate("ai_agg")
        guard_agg_batch(rows, text, group_by, config=self.config)
        inputs = agg_inputs(rows, group_by, text, prompt, order=order)
        return inputs.select("group_key", self._complete("ai_agg", "agg_input", "{{ input }}", None, model, "json").alias("result"))
