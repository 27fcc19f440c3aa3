"""Validity ranges, lineages and histories over rows of a versioned index.

Rows: row_id, lineage_id, snippet_id, file_path, qualname, ordinal, kind, line_start, line_end, seq_added, seq_removed
(null while valid), any further columns. A lineage has at most one valid row per version, so groups by lineage are
bounded by the number of versions.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ranking import spread_row_number

PLACE = ["file_path", "qualname", "ordinal"]
# fixed value: the note in place of a diff
GONE = "unavailable: the stored text of a version was removed by vacuum()"


def between(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows valid at some version from ``lo`` to ``hi``."""
    if lo > hi:
        raise ValueError("not in version order")
    return rows.where((F.col("seq_added") <= hi) & (F.col("seq_removed").isNull() | (F.col("seq_removed") > lo)))


def as_of(rows: DataFrame, seq: int) -> DataFrame:
    return between(rows, seq, seq)


def groups(rows: DataFrame, extra: list[str] | None = None, show: tuple[str, ...] = (), label: str = "seq_added") -> DataFrame:
    """Per lineage: number of versions, the ``label`` of their starts in order, and the latest row's id, place and ``show``."""
    extra = extra or []
    shown = ("row_id", "snippet_id", *PLACE, "seq_removed", *show)
    last = F.max_by(F.struct(*shown), F.struct("seq_added", "row_id"))
    order = F.sort_array(F.collect_list(F.struct("seq_added", "row_id", F.col(label).alias("label"))))
    g = rows.groupBy(*extra, "lineage_id").agg(F.count("*").alias("n_versions"), order["label"].alias("versions"), last.alias("l"))
    return g.select(*extra, "lineage_id", "n_versions", "versions", *[F.col(f"l.{c}").alias(c) for c in shown])


def history(rows: DataFrame, extra: list[str] | None = None, last: Column | int | None = None) -> DataFrame:
    """Every row with how it came about: added, moved (same code elsewhere), reverted (code seen before), modified.

    ``valid_through`` is the last version at which the row was valid; of rows that still are it is ``last``, the number
    of the latest version (a column where that differs by repository), null where it is not given.
    """
    w = Window.partitionBy("lineage_id").orderBy("seq_added", "row_id")
    seen = F.row_number().over(Window.partitionBy("lineage_id", "snippet_id").orderBy("seq_added", "row_id")) > 1
    before = F.lag("snippet_id").over(w)
    nth = F.row_number().over(w)
    change = F.when(nth == 1, "added").when(before.eqNullSafe(F.col("snippet_id")), "moved").when(seen, "reverted").otherwise("modified")
    through = F.coalesce(F.col("seq_removed") - 1, last if isinstance(last, Column) else F.lit(last).cast("int"))
    return rows.select(*(extra or []), "lineage_id", "row_id", "snippet_id", *PLACE, "seq_added", "seq_removed", through.alias("valid_through"), nth.alias("version_no"), change.alias("change"), before.alias("prev_snippet_id"))


def named(rows: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    """All rows of the lineages that ever had a function of that name: the qualified name or its last parts, literally."""
    q = F.col("qualname")
    hit = ((q == name) | q.endswith("." + name)) & (F.col("kind").isin("function", "method") | (q == "<module>"))
    if file_path is not None:
        hit = hit & (F.col("file_path") == file_path)
    return rows.join(rows.where(hit).select("lineage_id").distinct(), "lineage_id", "left_semi")


def unified_diffs(hist: DataFrame, texts: DataFrame, label: str = "seq_added") -> DataFrame:
    """Add ``diff`` from the version before (null, with ``diff_note``, where a text is gone) to a history.

    The two sides are named by ``label``. Texts of both are joined by content, each where it is needed.
    """

    @F.pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        made = [None if o is None or n is None else "".join(difflib.unified_diff(o.splitlines(True), n.splitlines(True), str(x), str(y))) for o, n, x, y in zip(old, new, a, b)]
        return pd.Series(made, dtype="object")

    was = F.lag(label).over(Window.partitionBy("lineage_id").orderBy("seq_added", "row_id"))
    t = texts.select("snippet_id", F.col("text").alias("new_text"))
    p = texts.select(F.col("snippet_id").alias("prev_snippet_id"), F.col("text").alias("old_text"))
    h = hist.withColumn("prev_label", was).join(t, "snippet_id", "left").join(p, "prev_snippet_id", "left")
    h = h.withColumn("diff", F.when(F.col("version_no") > 1, diff("old_text", "new_text", F.col("prev_label").cast("string"), F.col(label).cast("string"))))
    note = F.when((F.col("version_no") > 1) & F.col("diff").isNull(), F.lit(GONE))
    return h.withColumn("diff_note", note).drop("new_text", "old_text", "prev_label")


def live_texts(texts: DataFrame, rows: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """Texts that versions from ``floor`` on need, and those that can go."""
    live = rows.where(F.col("seq_removed").isNull() | (F.col("seq_removed") > floor)).select("snippet_id").distinct()
    return texts.join(live, "snippet_id", "left_semi"), texts.join(live, "snippet_id", "left_anti")


def backfill(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``row_id, new_lineage_id`` for all rows, from their ranges alone.

    A row opened at a version goes on from one closed there with the same place, else from one with the same content
    (one to one, in order of row id), else it starts its own lineage. Chains are closed by pointer doubling, so a
    lineage of n rows takes log2 n rounds.
    """
    from ..session import cut

    extra = extra or []
    rows = cut(rows.select(*extra, "row_id", *PLACE, "snippet_id", "seq_added", "seq_removed"))
    c = rows.where("seq_removed is not null").select(*extra, F.col("row_id").alias("c_id"), *PLACE, "snippet_id", F.col("seq_removed").alias("at"))
    o = rows.select(*extra, "row_id", *PLACE, "snippet_id", F.col("seq_added").alias("at"))
    by_key = o.join(c.drop("snippet_id").groupBy(*extra, *PLACE, "at").agg(F.min("c_id").alias("c_id")), [*extra, *PLACE, "at"])
    one = cut(by_key.groupBy("c_id").agg(F.min("row_id").alias("row_id")))
    left_o = o.join(one, "row_id", "left_anti").select(*extra, "at", "snippet_id", "row_id")
    left_c = c.join(one, "c_id", "left_anti").select(*extra, "at", "snippet_id", "c_id")
    left_o = left_o.join(left_c.select(*extra, "at", "snippet_id").distinct(), [*extra, "at", "snippet_id"], "left_semi")
    key = [*extra, "at", "snippet_id"]
    two = spread_row_number(left_o, key, ["row_id"]).join(spread_row_number(left_c, key, ["c_id"]), [*key, "rn"]).select("c_id", "row_id")
    links = cut(one.select("row_id", F.col("c_id").alias("to")).unionByName(two.select("row_id", F.col("c_id").alias("to"))))
    while True:
        far = links.alias("a").join(links.alias("b"), F.col("a.to") == F.col("b.row_id"), "left")
        nxt = cut(far.select(F.col("a.row_id").alias("row_id"), F.coalesce("b.to", "a.to").alias("to"), F.col("b.to").isNotNull().alias("more")))
        links, more = nxt.drop("more"), not nxt.where("more").limit(1).isEmpty()
        if not more:
            break
    return rows.select("row_id").join(links, "row_id", "left").select("row_id", F.coalesce("to", "row_id").alias("new_lineage_id"))


def first_hits(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Best-scoring version of each lineage: ``query_id, lineage_id, score, row_id`` from ranked ``query_id, id`` of texts.

    ``rows`` carry ``vector_id``. Lineages that share a vector share the score and come in order of place.
    """
    hits = ranked.join(rows.select(F.col("vector_id").alias("id"), "lineage_id", "row_id", "snippet_id", "seq_added", "file_path", "line_start"), "id")
    first = F.min_by(F.struct("score", "rank", "row_id", "snippet_id", "seq_added", "file_path", "line_start"), F.struct("rank", "file_path", "line_start", "row_id"))
    return hits.groupBy("query_id", "lineage_id").agg(first.alias("f")).select("query_id", "lineage_id", "f.*")


def grouped_results(ranked: DataFrame, rows: DataFrame, k: int, show: tuple[str, ...] = (), label: str = "seq_added") -> DataFrame:
    """One result per lineage, ranked by its best version and showing its latest.

    ``query_id, rank, score, lineage_id, snippet_id, place, n_versions, versions, matched_seq, matched_snippet_id,
    matched_differs``.
    """
    best = first_hits(ranked, rows)
    w = Window.partitionBy("query_id").orderBy("rank", "file_path", "line_start", "row_id")
    top = best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    top = top.select("query_id", F.col("pos").alias("rank"), "score", "lineage_id", F.col("seq_added").alias("matched_seq"), F.col("snippet_id").alias("matched_snippet_id"))
    shown = groups(rows, show=("seq_added", *show), label=label).drop("row_id").withColumnsRenamed({"seq_added": "shown_seq"})
    shown = shown.drop(*([] if show else ["shown_seq", "seq_removed"]))
    return top.join(shown, "lineage_id").withColumn("matched_differs", F.col("matched_snippet_id") != F.col("snippet_id"))


def widened(ranked_at: Callable[[int, DataFrame], DataFrame], queries: DataFrame, rows: DataFrame, k: int, start: int, size: int, show: tuple[str, ...] = (), label: str = "seq_added", steady: bool = False) -> DataFrame:
    """``grouped_results`` from ranked lists that double in length until every query has ``k`` lineages.

    ``ranked_at(n, queries)`` gives the best ``n`` texts of each query; ``size`` is the number of texts there are, with
    which the widening ends. ``steady`` says that a longer list only goes on from a shorter one, and that one of fewer
    than ``n`` has all there is: then a query that has its lineages, or no more texts, is not asked again.
    """
    n, done = start, []
    while True:
        ranked = ranked_at(n, queries)
        out = grouped_results(ranked, rows, k, show, label)
        if n >= size:
            break
        if steady:
            out = written(out, "grouped")
        short = queries.select("query_id").join(out.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
        if steady:
            short = short.join(ranked.groupBy("query_id").count().where(F.col("count") >= n), "query_id", "left_semi").distinct()
            queries = written(queries.join(short, "query_id", "left_semi"), "queries")
            short = queries
        if short.isEmpty():
            break
        if steady:
            done.append(out.join(queries.select("query_id").distinct(), "query_id", "left_anti"))
        n *= 2
    return reduce(DataFrame.unionByName, [*done, out])


def span(first, last) -> str:
    """The versions a row is valid at: one label, or the first and the last."""
    return str(first) if first == last else f"{first}..{last}"
