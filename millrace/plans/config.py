"""Settings of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    model_generate: str | None = None
    model_classify: str | None = None
    model_extract: str | None = None
    embedding_model: str | None = None
    chunk_target_tokens: int = 512
    chunk_overlap_tokens: int = 0
    max_batch_rows: int = 10_000
    max_est_tokens: int = 5_000_000
    max_agg_group_tokens: int = 100_000
    est_output_tokens_per_row: int | None = None
    ai_sample_rows: int | None = None
    max_output_tokens: int | None = None
    thinking_budget: int | None = None
    cost_per_1k_tokens: float | None = None
    run_log_path: str | None = None
    ai_functions_enabled: bool | str = False
    allow_full_reembed: bool = False
    embedding_canary_similarity_threshold: float = 0.999
    embedding_canary_vector_dimension: int | None = 768
    embedding_canary_severity: str = "warn"

    def model_for(self, function: str) -> str:
        """The model of a function; classify, extract and ai_agg fall back to that of generate."""
        model = {"embed": self.embedding_model, "generate": self.model_generate, "classify": self.model_classify, "extract": self.model_extract}.get(function)
        if function != "embed":
            model = model or self.model_generate
        if model is None:
            raise ValueError(f"{function}: no model is set")
        return model
