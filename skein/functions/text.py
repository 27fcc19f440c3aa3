"""The code-aware tokenizer as one Spark expression, and hashes of text."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENT = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
CAMEL = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"


def code_tokens(text: Column) -> Column:
    """Identifiers lower case without underscores, each followed by its camel and snake parts if there are several.

    A null text gives an empty array. Digits are ASCII digits.
    """

    def parts(t: Column) -> Column:
        whole = F.regexp_replace(F.lower(t), "_", "")
        found = F.regexp_extract_all(t, F.lit(CAMEL), F.lit(0))
        return F.concat(
            F.filter(F.array(whole), lambda z: z != ""),
            F.when(F.size(found) > 1, F.transform(found, F.lower)).otherwise(F.array().cast("array<string>")),
        )

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENT), F.lit(0))
    return F.flatten(F.transform(words, parts))


_IDENT, _CAMEL = re.compile(IDENT), re.compile(CAMEL)


@lru_cache(maxsize=200_000)
def _split(word: str) -> tuple[str, ...]:
    whole = word.lower().replace("_", "")
    parts = _CAMEL.findall(word)
    return ((whole,) if whole else ()) + (tuple(p.lower() for p in parts) if len(parts) > 1 else ())


def count_terms(text: str | None) -> Counter:
    """The tokens of ``code_tokens``, counted; none for a null text."""
    out: Counter = Counter()
    for word, n in Counter(_IDENT.findall(text or "")).items():
        for t in _split(word):
            out[t] += n
    return out


def term_counts(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key, dl, terms, tfs``: one row per record with its terms and their counts. Null or empty texts have none.

    A record is counted where it lies, so nothing is shuffled; identifiers that recur are split once per worker.
    """

    def run(batches):
        for pdf in batches:
            made = [count_terms(t) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "dl": [sum(c.values()) for c in made], "terms": [list(c) for c in made], "tfs": [list(c.values()) for c in made]})

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, text).mapInPandas(run, f"`{key}` {kind}, dl long, terms array<string>, tfs array<long>")


#: The same tokens in DuckDB's SQL (its patterns have no lookahead); ``{0}`` is the text.
CODE_TOKENS_SQL = r"""flatten(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'),
  lambda t: list_concat(list_filter([replace(lower(t), '_', '')], lambda z: z <> ''),
    case when len(regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]+[a-z]*|[a-z]+|[0-9]+')) > 1
      then list_transform(regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda p: lower(p)) else [] end)))"""


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text with runs of white space folded to one blank."""
    x = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.substring(F.sha2(x, 256), 1, 16)


def vector_id(hex_id: Column) -> Column:
    """The 63-bit number of a 16-digit hexadecimal id."""
    return F.shiftrightunsigned(F.conv(hex_id, 16, -10).cast("long"), 1)
