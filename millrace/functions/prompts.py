"""Prompts and output schemas as versioned code, and what is made of them on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import col

_SLOT = re.compile(r"\{\{\s*input\s*\}\}")
_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


@dataclass
class PromptRegistry:
    """Prompts and JSON schemas by name and version. Both are always named; there is no latest."""

    prompts: dict[tuple[str, str], str] = field(default_factory=dict)
    schemas: dict[tuple[str, str], str] = field(default_factory=dict)

    def add(self, name: str, version: str, prompt: str, schema: str | None = None) -> None:
        if not name or not version:
            raise ValueError("a prompt needs a name and a version")
        self.prompts[name, version] = prompt
        if schema is not None:
            self.schemas[name, version] = schema

    def prompt(self, name: str, version: str) -> str:
        return self._get(self.prompts, "prompt", name, version)

    def schema(self, name: str, version: str) -> str:
        return self._get(self.schemas, "schema", name, version)

    @staticmethod
    def _get(table: dict, what: str, name: str, version: str) -> str:
        if (name, version) not in table:
            raise KeyError(f"no {what} {name!r} of version {version!r}")
        return table[name, version]

    def resolve(self, prompt: str | None, schema: str | None, meta: dict[str, Any] | None) -> tuple[str | None, str | None]:
        """The prompt and schema of a call: given ones win, else those the model's ``meta`` names; the schema may be absent."""
        named = (meta or {}).get("ai_prompt")
        if prompt is None and named:
            key = (named["name"], named["version"])
            return self.prompt(*key), schema if schema is not None else self.schemas.get(key)
        return prompt, schema


def render_prompt(prompt: str | None, input_column: Column | str | None) -> Column:
    """The prompt with each ``{{ input }}`` replaced by the column; a null input gives a null prompt."""
    if prompt is None:
        raise ValueError("render_prompt: a prompt is required")
    parts = _SLOT.split(prompt)
    if len(parts) > 1 and input_column is None:
        raise ValueError("render_prompt: the prompt has a slot for input but no column was given")
    pieces: list[Column] = []
    for k, part in enumerate(parts):
        if k:
            pieces.append(col(input_column).cast("string"))
        if part:
            pieces.append(F.lit(part))
    return F.concat(*pieces) if pieces else F.lit("")


def prompt_overhead_chars(prompt: str | None, schema: str | None) -> int:
    """Characters of a call besides its input: the template without its slots, and the schema."""
    return (len(_SLOT.sub("", prompt)) if prompt else 0) + (len(schema) if schema else 0)


def _properties(schema: str) -> dict[str, dict]:
    return json.loads(schema).get("properties", {})


def schema_enum(schema: str, name: str | None = None) -> list[str]:
    """The allowed values of the named property, or of the first that has any."""
    for key, value in _properties(schema).items():
        if value.get("enum") and name in (None, key):
            return list(value["enum"])
    raise ValueError("schema_enum: no enum" + (f" for {name!r}" if name else ""))


def schema_label_field(schema: str) -> str:
    for key, value in _properties(schema).items():
        if value.get("enum"):
            return key
    raise ValueError("the schema has no enum to take a label from")


def json_kind(value: dict) -> str:
    """The type of a schema property; of several the first that is not null."""
    kind = value.get("type", "string")
    return next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind


def schema_struct(schema: str) -> T.StructType:
    """The struct of a JSON schema's properties; unknown types are strings."""
    fields = [T.StructField(k, _TYPES.get(json_kind(v), T.StringType())) for k, v in _properties(schema).items()]
    if not fields:
        raise ValueError("schema_struct: the schema has no properties")
    return T.StructType(fields)


def augment_prompt(prompt: str, schema: str | None) -> str:
    """The prompt with the allowed values of each enum set before it; unchanged without enums."""
    rules = [f'- "{k}": one of {", ".join(map(str, v["enum"]))}, exactly as written here.' for k, v in (_properties(schema) if schema else {}).items() if v.get("enum")]
    return "Use only these values:\n" + "\n".join(rules) + "\n\n" + prompt if rules else prompt


def shape_instruction(schema: str | None, mode: str) -> str:
    """Words for providers without structured output: a bare label, or one JSON object with the schema's keys."""
    if mode == "label":
        return "\n\nAnswer with one of the allowed values and nothing else."
    keys = ", ".join(f"{k} ({json_kind(v)})" for k, v in (_properties(schema) if schema else {}).items())
    return f"\n\nAnswer with one JSON object on one line, holding these keys only: {keys}." if keys else ""


def generation_params(max_output_tokens: int | None = None, thinking_budget: int | None = None) -> dict[str, Any]:
    """Provider options that cap what a call may write."""
    out: dict[str, Any] = {}
    if max_output_tokens is not None:
        out["maxOutputTokens"] = int(max_output_tokens)
    if thinking_budget is not None:
        out["thinkingConfig"] = {"thinkingBudget": int(thinking_budget)}
    return {"generationConfig": out} if out else {}


def sql_literal(text: str) -> str:
    """A text as a SQL literal for queries written as strings (DataFrames use ``lit``)."""
    return "'" + text.replace("'", "''") + "'"


def field_of(result: Column | str, name: str, as_type: str = "string", *, strict: bool = True) -> Column:
    """A top-level field of a JSON result, cast; null for invalid JSON. A bad cast raises if ``strict``, else is null."""
    raw = F.get_json_object(col(result), f"$.{name}")
    return raw.cast(as_type) if strict else raw.try_cast(as_type)


def text_of(result: Column | str) -> Column:
    """The plain text of an unstructured result."""
    return col(result)
