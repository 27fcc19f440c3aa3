"""Source files of a directory tree as a DataFrame, and timelines of overlaid versions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: what is scanned
SUFFIXES = (".js", ".mjs", ".cjs", ".py")
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``file_path, content, file_hash`` of all source files below ``root``, with paths relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"/+$", "", root.removeprefix("file:"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/*", "")
    parents = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    skip = F.arrays_overlap(parents, F.array(*[F.lit(d) for d in SKIP_DIRS]))
    wanted = F.lower("file_path").rlike("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$")
    return df.select(rel.alias("file_path"), "content").where(wanted & ~skip).withColumn("file_hash", F.sha2("content", 256))


def overlay(layers: DataFrame, seq: int) -> DataFrame:
    """The files as of ``seq`` of layers ``seq, file_path, content``: of each path its latest layer; a null content deletes."""
    w = Window.partitionBy("file_path").orderBy(F.desc("seq"))
    top = layers.where(F.col("seq") <= seq).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return top.where("content is not null").select("file_path", F.col("content").cast("binary").alias("content")).withColumn("file_hash", F.sha2("content", 256))


def version_dirs(spark: SparkSession, overlays: str) -> list[tuple[str, str]]:
    """``(version, path)`` of the folders ``v2, v3, ..., v10`` below ``overlays``, by number. Other names are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(overlays)
    found = [f for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory()]
    names = [(f.getPath().getName(), f.getPath().toString()) for f in found]
    return sorted(((n, at) for n, at in names if n[1:].isascii() and n[1:].isdigit()), key=lambda x: int(x[0][1:]))


def timeline(spark: SparkSession, base: str, overlays: str) -> Iterator[tuple[str, DataFrame]]:
    """``(version, files)``: the base tree as v1, then each overlay folder laid over what came before. Overlays add and
    replace files; they delete none."""
    layers = scan(spark, base).select(F.lit(1).alias("seq"), "file_path", "content")
    yield "v1", overlay(layers, 1)
    for i, (name, at) in enumerate(version_dirs(spark, overlays), 2):
        layers = layers.unionByName(scan(spark, at).select(F.lit(i).alias("seq"), "file_path", "content"))
        yield name, overlay(layers, i)


def changed_files(known: DataFrame, now: DataFrame, group: list[str] | None = None, with_hash: bool = False) -> DataFrame:
    """``file_path, change`` (new, edited, removed) between two listings of ``file_path, file_hash``; ``group`` columns keep
    listings apart and come first. ``with_hash`` adds ``file_hash``, that of ``now``."""
    group = group or []
    k = known.select(*group, "file_path", F.col("file_hash").alias("old"), F.lit(1).alias("o"))
    n = now.select(*group, "file_path", F.col("file_hash").alias("new"), F.lit(1).alias("n"))
    both = k.join(n, [*group, "file_path"], "full_outer")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "edited")
    more = [F.col("new").alias("file_hash")] if with_hash else []
    return both.select(*group, "file_path", change.alias("change"), *more).where("change is not null")
