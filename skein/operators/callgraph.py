"""Questions to a call graph of definitions and calls joined by name.

``defs``: id, name, qualname, kind, file_path, line_start, line_end; ``calls``: caller_id, callee_name, line,
call_order (any type that sorts). Receivers are not resolved: a call is known by the last part of its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

REF = ["qualname", "kind", "file_path", "line_start", "line_end"]


def short(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def save(defs: DataFrame, calls: DataFrame, path: str) -> dict[str, int]:
    """Write the graph anew, calls laid out by the name called; returns the numbers of files, snippets and calls."""
    spark = defs.sparkSession
    defs.write.mode("overwrite").parquet(f"{path}/defs")
    calls.repartition("callee_name").sortWithinPartitions("callee_name").write.mode("overwrite").parquet(f"{path}/calls")
    d, c = load(spark, path)
    n = d.agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("snippets")).first()
    return {"files": n["files"], "snippets": n["snippets"], "calls": c.count()}


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/defs"), spark.read.parquet(f"{path}/calls")


def definition(defs: DataFrame, name: str) -> DataFrame:
    """Functions, methods and classes of that short or qualified name. ``Renderer.draw`` also finds other ``draw``."""
    hit = (F.col("name") == short(name)) | (F.col("qualname") == name)
    return defs.where(F.col("kind").isin("function", "method", "class") & hit).select(*REF).orderBy("file_path", "line_start")


def is_defined(defs: DataFrame, name: str) -> bool:
    hit = (F.col("name") == short(name)) | (F.col("qualname") == name)
    return not defs.where((F.col("kind") != "module") & hit).limit(1).isEmpty()


def callers(defs: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """Definitions that call the name, with the sorted lines of all its calls."""
    c = calls.where(F.col("callee_name") == short(name)).groupBy("caller_id").agg(F.sort_array(F.collect_list("line")).alias("call_lines"))
    return defs.join(c, defs["id"] == c["caller_id"]).select(*REF, "call_lines").orderBy("file_path", "line_start")


def callees(defs: DataFrame, calls: DataFrame, name: str | None) -> DataFrame:
    """What each definition of the name (None: every definition) calls, once per callee in source order, and where that is
    defined: a row per place of definition, or one with a null ``defined_at``. So a name with countless definitions
    gives rows, not one long list."""
    mine = defs.where(F.col("kind").isin("function", "method", "class"))
    if name is not None:
        mine = mine.where((F.col("name") == short(name)) | (F.col("qualname") == name))
    once = calls.join(mine.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").groupBy("caller_id", "callee_name")
    once = once.agg(F.min_by(F.struct("line", "call_order"), "call_order").alias("c")).select("caller_id", "callee_name", "c.*")
    first = once.join(mine.select(F.col("id").alias("caller_id"), *REF), "caller_id")
    where = defs.where(F.col("kind") != "module").select(F.col("name").alias("callee_name"), F.concat_ws(":", "file_path", "line_start").alias("defined_at"))
    return first.join(where, "callee_name", "left").select(*REF, "callee_name", "line", "call_order", "defined_at").orderBy("file_path", "line_start", "call_order", "defined_at")


def calls_before(defs: DataFrame, calls: DataFrame, x: str, y: str) -> DataFrame:
    """Definitions in which some call of ``x`` comes before some call of ``y``; one pass, no self-join."""
    is_x, is_y = F.col("callee_name") == short(x), F.col("callee_name") == short(y)
    c = calls.where(is_x | is_y).groupBy("caller_id").agg(
        F.min(F.when(is_x, F.col("call_order"))).alias("fx"), F.max(F.when(is_y, F.col("call_order"))).alias("ly"), F.min(F.when(is_x, F.col("line"))).alias("first_call_line"), F.max(F.when(is_y, F.col("line"))).alias("later_call_line")
    )
    hit = c.where("fx < ly")
    return defs.join(hit, defs["id"] == hit["caller_id"]).select(*REF, "first_call_line", "later_call_line").orderBy("file_path", "line_start")


def transitive_callers(defs: DataFrame, calls: DataFrame, name: str, max_depth: int = 10) -> DataFrame:
    """Every definition that reaches the name, with the least depth and the callee through which it is first reached.

    A breadth-first walk by names; each name is expanded once, so cycles end it, and each round's rows are written to
    the shared folder. A recursive name is its own caller at depth 1; module code is reported but has no callers.
    """
    spark = defs.sparkSession
    edges = cut(calls.select("caller_id", "callee_name").distinct().join(defs.select(F.col("id").alias("caller_id"), "name", "kind"), "caller_id"))
    frontier = spark.createDataFrame([(short(name),)], "name string")
    names, found = frontier, None
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.withColumnRenamed("name", "callee_name"), "callee_name")
        step = step.groupBy("caller_id", "name", "kind").agg(F.min("callee_name").alias("via"))
        if found is not None:
            step = step.join(found.select("caller_id"), "caller_id", "left_anti")
        step = cut(step.withColumn("depth", F.lit(depth)))
        found = step if found is None else found.unionByName(step)
        frontier = cut(step.where("kind <> 'module'").select("name").distinct().join(names, "name", "left_anti"))
        if frontier.isEmpty():
            break
        names = names.unionByName(frontier)
    return defs.join(found.select("caller_id", "depth", "via"), defs["id"] == F.col("caller_id")).select(*REF, "depth", "via").orderBy("depth", "file_path", "line_start")
