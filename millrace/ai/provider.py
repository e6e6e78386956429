"""Model providers: what answers embed and completion calls, a batch at a time."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from typing import Any, Protocol

import numpy as np

from millrace.functions.prompts import json_kind


class AiProvider(Protocol):
    """Runs on executors: must be picklable, and deterministic enough to be retried."""

    structured: bool

    def embed_batch(self, texts: Sequence[str], model: str) -> list[list[float]]: ...

    def complete_batch(self, prompts: Sequence[str], model: str, *, schema: str | None, options: dict[str, Any]) -> list[str | None]: ...


class LocalProvider:
    """A deterministic provider without a network: hashed word features, and answers by rules that SQL can say too."""

    structured = True

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed_batch(self, texts: Sequence[str], model: str) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in re.findall(r"\w+", text.lower()) or [text]:
                h = hashlib.md5(f"{model}:{word}".encode()).digest()
                v[int.from_bytes(h[:4], "big") % self.dimension] += 1 if h[4] % 2 else -1
            out.append([float(x) for x in v / (np.linalg.norm(v) or 1.0)])
        return out

    def complete_batch(self, prompts: Sequence[str], model: str, *, schema: str | None, options: dict[str, Any]) -> list[str | None]:
        return [self._answer(p, schema) for p in prompts]

    @staticmethod
    def _answer(prompt: str, schema: str | None) -> str:
        """An answer from the whole prompt: it itself with its white space collapsed; by schema the allowed value it
        holds most often (of a tie the first), its first number (0 if none), whether it asks, else itself."""
        whole = re.sub(r"[\t\n\f\r ]+", " ", prompt).strip(" ")
        if schema is None:
            return whole
        low, out = prompt.lower(), {}
        for name, spec in json.loads(schema).get("properties", {}).items():
            kind, values = json_kind(spec), spec.get("enum")
            if values:
                counts = [low.count(str(v).lower()) for v in values]
                out[name] = values[counts.index(max(counts))]
            elif kind in ("integer", "number"):
                found = re.search(r"[0-9]+", prompt)
                out[name] = int(found.group(0)) if found else 0
            elif kind == "boolean":
                out[name] = "?" in prompt
            else:
                out[name] = whole
        return json.dumps(out)
