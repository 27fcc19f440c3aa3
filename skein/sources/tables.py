"""Readers for the Parquet tables of a directory, with the spelling of dirty columns settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(c: Column) -> Column:
    """Ids and hashes: without blanks and algorithm prefix, lower case; empty is null."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^sha-?256[:=]\s*", "")
    return F.when(x != "", x)


def clean_path(c: Column) -> Column:
    """Relative paths with single forward slashes and no leading ``./``."""
    x = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(x, r"^(\./)+", "")


def clean_label(c: Column) -> Column:
    """Version labels: trimmed, lower case; empty is null."""
    x = F.lower(F.trim(c))
    return F.when(x != "", x)


def clean_language(c: Column) -> Column:
    """``python`` / ``javascript`` for their spellings, others lower case; empty is null."""
    x = F.lower(F.trim(c))
    return (
        F.when(x.isin("py", "python", "python3"), "python")
        .when(x.isin("js", "javascript", "mjs", "cjs", "node"), "javascript")
        .when(x != "", x)
    )


def language_of_path(c: Column) -> Column:
    """The language that a file's extension names, null for other extensions."""
    ext = F.regexp_extract(F.lower(c), r"\.([a-z0-9]+)$", 1)
    return F.when(ext == "py", "python").when(ext.isin("js", "mjs", "cjs"), "javascript")


def clean_source(c: Column) -> Column:
    """Source names in lower case with underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
