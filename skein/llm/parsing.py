"""Files whose texts do not parse in the language of their extension.

Every distinct text is recognised once per language by the generalised LL readers of ``python_source`` and
``javascript_source``, all dialects of a language running together; a text is bad if every dialect rejects it. The
verdict depends on the text alone, not on its length nor on the interpreter that runs the worker.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import clean_id, clean_path, language_of_path
from . import javascript_source, python_source


def parses(text: str, language: str) -> bool:
    """Does some dialect of ``language`` accept ``text``? Other languages accept everything."""
    if language == "javascript":
        return javascript_source.accepts(text)
    return language != "python" or python_source.accepts(text)


def places(snippets: DataFrame) -> DataFrame:
    """``repo, file_path, language, snippet_id``: each text a file ever held, once. Files of other languages are left out."""
    s = snippets.select("repo", clean_path(F.col("file_path")).alias("file_path"), clean_id(F.col("snippet_id")).alias("snippet_id"))
    return s.withColumn("language", language_of_path(F.col("file_path"))).where("language is not null").select("repo", "file_path", "language", "snippet_id").distinct()


def bad_texts(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """``snippet_id, language`` of the texts that do not parse. Null texts and vacuumed ones (no row) don't count."""
    used = snippets.select(clean_id(F.col("snippet_id")).alias("snippet_id"), language_of_path(clean_path(F.col("file_path"))).alias("language")).where("language is not null").distinct()
    t = texts.select(clean_id(F.col("snippet_id")).alias("snippet_id"), "text").where("text is not null")

    def run(batches):
        for pdf in batches:
            bad = [not parses(t, x) for t, x in zip(pdf["text"], pdf["language"])]
            yield pdf.loc[bad, ["snippet_id", "language"]]

    found = t.join(used, "snippet_id").select("snippet_id", "language", "text").mapInPandas(run, "snippet_id string, language string")
    return found.distinct()


def bad_files(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """``repo, file_path, language`` of the files that at any version held a text that does not parse."""
    hit = places(snippets).join(bad_texts(texts, snippets), ["snippet_id", "language"], "left_semi")
    return hit.select("repo", "file_path", "language").distinct()


def bad_rates(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """Per repository and language: files, files flagged and their share."""
    files = places(snippets).select("repo", "file_path", "language").distinct()
    bad = bad_files(texts, snippets).withColumn("bad", F.lit(1))
    both = files.join(bad, [files["repo"].eqNullSafe(bad["repo"]), files["file_path"] == bad["file_path"]], "left").select(files["repo"], files["language"], "bad")
    n = F.count("*")
    return both.groupBy("repo", "language").agg(n.alias("n_files"), F.count("bad").alias("n_bad"), F.round(F.count("bad") / n, 6).alias("rate"))
