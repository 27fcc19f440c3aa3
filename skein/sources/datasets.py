"""A repository made of documents: source files of a table that parse, under grouped paths, and the sinks of reports."""

from __future__ import annotations

import ast
import json
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import spread_row_number

# fixed values: the lengths of files that are taken, and the files of a folder
SHORTEST, LONGEST, FOLDER = 60, 6000, 25


def parses(text: Column) -> Column:
    """Does the interpreter of the workers parse the text as Python? Null does not."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def ok(t) -> bool:
            if t is None:
                return False
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(t)
                return True
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False

        return pd.Series([ok(t) for t in s], dtype="bool")

    return run(text)


def folder_path(i: Column) -> Column:
    """``pkg_003/mod_00081.py``: files in folders of ``FOLDER``."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.lit("pkg_"), pad(F.floor(i / FOLDER), 3), F.lit("/mod_"), pad(i, 5), F.lit(".py"))


def repository(docs: DataFrame, key: str, text: str, n: int, seed: int = 0) -> DataFrame:
    """``file_path, content, file_hash`` of ``n`` documents that parse and are neither short nor long, in an order that
    ``seed`` and the key decide. A line end is put behind texts without one. Fewer documents give fewer files."""
    ok = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.char_length("text").between(SHORTEST, LONGEST))
    order = F.xxhash64(F.lit(seed), "key", "text")
    taken = ok.where(parses(F.col("text"))).orderBy(order, "key", "text").limit(n)
    numbered = spread_row_number(taken.withColumns({"_g": F.lit(0), "_h": order}), ["_g"], ["_h", "key", "text"])
    body = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))).cast("binary")
    return numbered.select(folder_path(F.col("rn") - 1).alias("file_path"), body.alias("content")).withColumn("file_hash", F.sha2("content", 256))


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one JSON file, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray((json.dumps(report, indent=2, default=str) + "\n").encode()))
    out.close()


def write_rows(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, one file a partition."""
    df.write.mode("overwrite").json(path)
