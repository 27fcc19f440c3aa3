"""Classification of what changed between two sets of snippets: unchanged, modified, moved, added, deleted.

A key on both sides is unchanged or modified, whatever else holds the same code. Of the others, new and old records
with the same content pair up one to one in order of (file, qualified name, ordinal) and have moved; what is left was
added or deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import row_number_of_few, spread_row_number

KEY = ["file_path", "qualname", "ordinal"]


def diff_snippets(old: DataFrame, new: DataFrame, group: list[str] | None = None, few: bool = False) -> DataFrame:
    """``group, change_class, old_* and new_*`` (key columns and snippet_id) of two sets with unique keys.

    ``group`` columns (for example the repository) keep sets apart. Key columns and contents are compared as given;
    a null content equals only a null content. Empty sides give only additions or only deletions. ``few`` says that
    both sides have been counted and are small enough for one task to sort any group of them.
    """
    group = group or []
    cols = [*KEY, "snippet_id"]
    o = old.select(*group, *KEY, F.struct(*cols).alias("o"))
    n = new.select(*group, *KEY, F.struct(*cols).alias("n"))
    both = o.join(n, [*group, *KEY], "full_outer")
    kind = F.when(F.col("o").isNull(), "fresh").when(F.col("n").isNull(), "gone").when(F.col("o.snippet_id").eqNullSafe(F.col("n.snippet_id")), "unchanged").otherwise("modified")
    both = both.select(*group, "o", "n", kind.alias("c"))
    if not few:
        both = cut(both)
    kept = both.where("c in ('unchanged', 'modified')").withColumnRenamed("c", "change_class")

    def side(c: str, s: str) -> DataFrame:
        x = both.where(F.col("c") == c).select(*group, F.col(f"{s}.snippet_id").alias("sid"), *[F.col(f"{s}.{k}").alias(k) for k in KEY], s)
        x = row_number_of_few(x, [*group, "sid"], KEY) if few else spread_row_number(x, [*group, "sid"], KEY)
        return x.select(*group, "sid", "rn", s)

    pairs = side("gone", "o").join(side("fresh", "n"), [*group, "sid", "rn"], "full_outer")
    moved = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("moved")
    rest = pairs.select(*group, "o", "n", moved.alias("change_class"))
    out = kept.unionByName(rest)
    return out.select(*group, "change_class", *[F.col(f"{s}.{c}").alias(f"{p}_{c}") for s, p in (("o", "old"), ("n", "new")) for c in cols])


def records(diff: DataFrame, change_class: str, group: list[str] | None = None) -> DataFrame:
    """The records of one class in order of their key: deleted ones by the old key, all others by the new one."""
    side = "old" if change_class == "deleted" else "new"
    return diff.where(F.col("change_class") == change_class).orderBy(*(group or []), *[f"{side}_{k}" for k in KEY])


def counts(diff: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The number of records of each class, 0 where there are none."""
    classes = ["added", "deleted", "unchanged", "modified", "moved"]
    sums = [F.sum((F.col("change_class") == c).cast("long")).alias(c) for c in classes]
    return diff.groupBy(*(group or [])).agg(*sums)
