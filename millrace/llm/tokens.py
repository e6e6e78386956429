"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the published pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _shipped(path: str) -> str:
    """Where this worker holds the file that the driver has shipped, else ``path`` itself."""
    try:
        own = SparkFiles.get(os.path.basename(path))
    except Exception:  # noqa: BLE001 - outside a session there are no files
        return path
    return own if os.path.exists(own) else path


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(_shipped(path), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of ``text``, whole texts; null for null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tokens = encoding(path)
        return pd.Series([None if t is None else len(tokens.encode_ordinary(t)) for t in texts], dtype="Int64")

    # So marked, a filter on the size does not make Spark count every text a second time.
    return count.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def sized(df: DataFrame, text: str, out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """Rows with a non-blank ``text`` and its size; a text of white space alone is blank."""
    ship(df.sparkSession)
    df.sparkSession.sparkContext.addFile(path)  # workers need not have the file
    return df.filter(F.col(text).rlike(r"[^\p{IsWhite_Space}]")).withColumn(out, token_count(text, path))
