"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The encoder of a rank file, kept once per Python worker."""
    kept = sys.__dict__.setdefault("_lumenframe_encoders", {})
    if path not in kept:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keep`` columns and ``tokens``: the number of tokens of the whole text; NULL and empty texts have 0.

    Strings of special tokens count as ordinary text. ``path`` must name a file every executor can read.
    """
    vocabulary = path or vocabulary_path()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"
    src = df.select(*keep, df[text].alias("__text"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b["__text"]]
            yield b[keep].assign(tokens=n)

    return src.mapInPandas(kernel, schema)
