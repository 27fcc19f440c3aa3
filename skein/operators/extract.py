"""Definitions, calls and snippets of source files, one Arrow batch of whole files at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import javascript_extract, python_extract

_CALL = "struct<callee:string,line:int,col:int,receiver:string,order:int>"
SCHEMA = f"file_path string, language string, n int, name string, qualname string, kind string, line_start int, line_end int, snippet_id string, text string, calls array<{_CALL}>"


def facts(files: DataFrame, for_versioning: bool = False, strip_comments: bool = False) -> DataFrame:
    """One row per definition of ``files`` (file_path, content as bytes or text), ``n`` counting within the file.

    Files of other languages, empty ones and those that do not parse have no rows; bytes that are not UTF-8 are
    replaced.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["file_path"], pdf["content"]):
                if path is None or content is None:
                    continue
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                low = path.lower()
                lang = "python" if low.endswith(".py") else "javascript" if low.endswith((".js", ".mjs", ".cjs")) else None
                if lang is None:
                    continue
                made = (python_extract if lang == "python" else javascript_extract).extract(text, for_versioning, strip_comments)
                rows += [(path, lang, n, d["name"], d["qualname"], d["kind"], d["line_start"], d["line_end"], d["snippet_id"], d["text"], d["calls"]) for n, d in enumerate(made)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in "file_path language n name qualname kind line_start line_end snippet_id text calls".split()])

    return files.select("file_path", "content").mapInPandas(run, SCHEMA)


def call_graph(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(defs, calls)`` of extracted facts, with ids by hash of the place."""
    d = f.withColumn("id", F.xxhash64("file_path", "n"))
    defs = d.select("id", "snippet_id", "name", "qualname", "kind", "language", "file_path", "line_start", "line_end")
    calls = d.select(F.col("id").alias("caller_id"), "file_path", F.explode("calls").alias("c"))
    return defs, calls.select("caller_id", F.col("c.callee").alias("callee_name"), F.col("c.receiver").alias("receiver"), "file_path", F.col("c.line").alias("line"), F.col("c.order").alias("call_order"))


def snippets(files: DataFrame, strip_comments: bool = False) -> DataFrame:
    """The ``Snippet`` records of files: facts without classes, numbered among equal names of a file."""
    f = facts(files, True, strip_comments).where("kind <> 'class'")
    w = Window.partitionBy("file_path", "qualname").orderBy("n")
    return f.select("file_path", "qualname", (F.row_number().over(w) - 1).alias("ordinal"), "kind", "language", "line_start", "line_end", "snippet_id", "text")
