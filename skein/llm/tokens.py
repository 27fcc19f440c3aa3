"""Sizes of texts in tokens of a public vocabulary."""

from __future__ import annotations

import base64
import importlib.util
import os
import sys
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public vocabularies; ``SKEIN_TOKENIZERS`` or the parameter ``folder`` name another.
FOLDER = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str):
    """The encoder of a worker process, built once."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_vocabularies", os.path.join(folder, "__init__.py"))
    mod = importlib.util.module_from_spec(spec)
    sys.modules.setdefault("_vocabularies", mod)
    spec.loader.exec_module(mod)
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=mod.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        enc = encoder(folder, vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count(text)
