"""Checks on the driver before a model call becomes part of a plan."""

from __future__ import annotations

from millrace.plans.config import EngineConfig


class AiCallRefused(RuntimeError):
    """A gate refused a model call."""


def require_enabled(function: str, config: EngineConfig) -> None:
    """Off unless the setting reads ``true``; anything but true or false raises."""
    text = str(config.ai_functions_enabled).strip().lower()
    if text not in ("true", "false"):
        raise AiCallRefused(f"{function}: ai_functions_enabled must be true or false, not {config.ai_functions_enabled!r}")
    if text == "false":
        raise AiCallRefused(f"{function}: model calls are off; set ai_functions_enabled")


def require_safe_materialization(function: str, materialized: str | None) -> None:
    """A view would call the model on every read."""
    if materialized == "view":
        raise AiCallRefused(f"{function}: not in a view; use a table or an incremental model")


def require_full_refresh_gate(function: str, materialized: str | None, full_refresh: bool | None) -> None:
    """An incremental model must say what a full refresh means for it; False is an answer."""
    if materialized == "incremental" and full_refresh is None:
        raise AiCallRefused(f"{function}: an incremental model must set full_refresh")


def require_reembed_allowed(function: str, rebuild: bool, config: EngineConfig) -> None:
    """A stored table of embeddings is only rebuilt whole where ``allow_full_reembed`` says so."""
    if function == "embed" and rebuild and not config.allow_full_reembed:
        raise AiCallRefused("embed: a full refresh embeds every row again; set allow_full_reembed")
