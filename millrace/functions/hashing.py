"""Content hashes of rows and fingerprints of configurations."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Mapping
from types import CodeType
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col


def content_hash(text: Column | str) -> Column:
    """SHA-256 of a text, lower-case hex; null for null."""
    return F.sha2(col(text), 256)


def joined_hash(*parts: Column | str, framed: bool = False) -> Column:
    """One hash over several values, null as empty, in the order given.

    Plain framing joins with ``|``, so ``a|b`` + ``c`` equals ``a`` + ``b|c``; ``framed`` puts each
    part's length before it and tells null from empty.
    """
    if framed:
        texts = [F.coalesce(F.concat(F.length(col(p).cast("string")), F.lit(":"), col(p).cast("string")), F.lit("~")) for p in parts]
    else:
        texts = [F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]
    out = [texts[0]]
    for t in texts[1:]:
        out += [F.lit("|"), t]
    return F.sha2(F.concat(*out), 256)


def fingerprint(settings: Mapping[str, Any]) -> str:
    """MD5 of ``key=value`` pairs sorted by key: equal settings compare equal whatever their order."""
    return hashlib.md5("&".join(f"{k}={settings[k]}" for k in sorted(settings)).encode()).hexdigest()


def chunk_fn_fingerprint(
    *, target_tokens: int, overlap_tokens: int, join_separator: str, id_column: str, order_column: str, text_column: str, partition_column: str | None = None, label_column: str | None = None, extra: str | None = None
) -> str:
    """Identity of a chunking configuration; the names of columns count."""
    return fingerprint(dict(locals()))


def embedding_fn_fingerprint(model: str | None, dimension: int | None = None, extra: str | None = None) -> str:
    """Identity of an embedding configuration."""
    if model is None:
        raise ValueError("embedding_fn_fingerprint: set embedding_model or pass model")
    return fingerprint({"model": model, "dimension": dimension, "extra": extra})


def _named(code: CodeType) -> set[str]:
    """The names that a function's code refers to, those of its inner functions included."""
    names = set(code.co_names)
    for inner in code.co_consts:
        if isinstance(inner, CodeType):
            names |= _named(inner)
    return names


def call_closure(*functions: Callable) -> list[Callable]:
    """The functions of this package that the given ones reach by name, themselves included, in order of name."""
    package = __name__.partition(".")[0]
    found: dict[str, Callable] = {}
    waiting = list(functions)
    while waiting:
        f = inspect.unwrap(waiting.pop())
        key = f"{f.__module__}.{f.__qualname__}"
        if key in found:
            continue
        found[key] = f
        names, scope = _named(f.__code__), f.__globals__
        owner = scope.get(f.__qualname__.rpartition(".")[0])
        spaces = [owner, *[scope[n] for n in names if inspect.ismodule(scope.get(n)) and scope[n].__name__.startswith(package)]]
        for name in names:
            for one in (scope.get(name), *[getattr(space, name, None) for space in spaces if space is not None]):
                if inspect.isfunction(one) and (one.__module__.startswith(package) or one.__module__ == f.__module__):
                    waiting.append(one)
    return [found[k] for k in sorted(found)]


def logic_hash(*functions: Callable) -> str:
    """SHA-256 over the source of the given functions and all they call in this package: which revision of the code made a row."""
    return hashlib.sha256("\n".join(inspect.getsource(f) for f in call_closure(*functions)).encode()).hexdigest()
