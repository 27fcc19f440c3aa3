"""What changed between consecutive full snapshots.

Rows are reduced to compact arrays: a 128-bit hash of the key, a 64-bit hash of the compared value, the snapshot's
rank and the delivery time. The arrays are spread over hash buckets of the key, so neither a repository nor a version
can fill a task, and each bucket finds its differences in numpy: one sort, then ``searchsorted`` for the same key in
the snapshot before and after. Full keys and values are fetched only for the keys that differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import buckets_for, cut
from ..sources.tables import clean_id, clean_path

#: So many differing keys (of 44 bytes each) are broadcast at most.
FEW = 300_000
_OUT = "repo_h long, seq int, at_seq int, h1 long, h2 long, change string, n long"


def _starts(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any of the sorted columns."""
    first = np.ones(len(cols[0]), bool)
    if len(first):
        first[1:] = False
        for c in cols:
            first[1:] |= c[1:] != c[:-1]
    return first


def diff_arrays(repo: np.ndarray, h1: np.ndarray, h2: np.ndarray, idx: np.ndarray, when: np.ndarray, val: np.ndarray, null: np.ndarray) -> dict[str, np.ndarray]:
    """Differences within one bucket, as positions into the input arrays.

    Of several rows of a key in one snapshot the latest holds (the last in ``when``, then the larger value). A null
    value means the last known one; while none is known, nothing counts as changed. Returns ``kept`` (the row that
    holds for each key and snapshot), ``fresh`` (not in the snapshot before), ``gone`` (not in the one after) and
    ``changed``. The caller drops fresh rows of first snapshots and gone rows of last ones.
    """
    order = np.lexsort((val, ~null, when, idx, h2, h1, repo))
    key = np.cumsum(_starts(repo[order], h1[order], h2[order])) - 1 if len(order) else np.zeros(0, np.int64)
    at = idx[order].astype(np.int64)
    last = np.ones(len(order), bool)
    last[:-1] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    order, key, at = order[last], key[last], at[last]
    v, missing = val[order], null[order]
    pos = np.arange(len(order))
    known = np.maximum.accumulate(np.where(missing, -1, pos)) if len(order) else pos
    ok = (known >= 0) & (key[np.maximum(known, 0)] == key)
    v = np.where(ok, v[np.maximum(known, 0)], 0) if len(order) else v
    code = key * (int(at.max(initial=0)) + 3) + at + 1
    n = len(code)

    def find(x: np.ndarray) -> np.ndarray:
        p = np.searchsorted(code, x)
        return np.where((p < n) & (code[np.minimum(p, max(n - 1, 0))] == x), p, -1) if n else np.zeros(0, np.int64)

    before, after = find(code - 1), find(code + 1)
    changed = (before >= 0) & ok & ok[before] & (v != v[before]) if n else np.zeros(0, bool)
    return {"kept": order, "fresh": order[before < 0], "gone": order[after < 0], "changed": order[changed]}


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    a = {c: pdf[c].to_numpy() for c in ("repo_h", "seq", "idx", "h1", "h2", "w")}
    null = pdf["v"].isna().to_numpy()
    nxt = pdf["next_seq"].fillna(-1).to_numpy(np.int64)
    val = pdf["v"].fillna(0).to_numpy(np.int64)
    d = diff_arrays(a["repo_h"], a["h1"], a["h2"], a["idx"], a["w"], val, null)

    def rows(p: np.ndarray, change: str, later: bool) -> pd.DataFrame:
        p = p[nxt[p] >= 0] if later else p[a["idx"][p] > 0]
        return pd.DataFrame({"repo_h": a["repo_h"][p], "seq": (nxt if later else a["seq"])[p].astype(np.int32), "at_seq": a["seq"][p], "h1": a["h1"][p], "h2": a["h2"][p], "change": change, "n": 1})

    kept = pd.DataFrame({"repo_h": a["repo_h"][d["kept"]], "seq": a["seq"][d["kept"]]}).groupby(["repo_h", "seq"]).size().rename("n").reset_index()
    kept = kept.assign(at_seq=kept["seq"], h1=0, h2=0, change="total")
    parts = [rows(d["fresh"], "added", False), rows(d["gone"], "removed", True), rows(d["changed"], "changed", False), kept]
    return pd.concat([p for p in parts if len(p)] or parts[:1])[["repo_h", "seq", "at_seq", "h1", "h2", "change", "n"]]


def snapshot_diff(df: DataFrame, keys: list[str], value: str, when: str) -> tuple[DataFrame, DataFrame]:
    """Differences of consecutive snapshots of ``df`` (columns ``repo, seq``, the keys, ``value`` and ``when``).

    Returns ``(changes, totals)``: changes are ``repo, seq, *keys, value, change`` with ``seq`` of the later snapshot
    and ``value`` as in the row that is named (for removals, the row that went away); totals are ``repo, seq, n``,
    the number of keys in each snapshot. A snapshot is compared with that of the nearest earlier ``seq``. Rows
    without ``repo`` or ``seq`` belong to no snapshot. Null keys are keys like others. Repeated rows count once.
    """
    # inner names, so that no column of the caller's can clash with those below
    names_of = {f"_k{i}": k for i, k in enumerate(keys)} | {"_value": value}
    df = df.where("repo is not null and seq is not null").select("repo", "seq", *[F.col(k).alias(x) for x, k in names_of.items()], F.col(when).alias("_when"))
    keys, value = [x for x in names_of if x != "_value"], "_value"
    hashed = df.select(
        F.xxhash64("repo").alias("repo_h"), "repo", "seq", F.xxhash64(F.struct(*keys)).alias("h1"), F.xxhash64(F.lit("second"), F.struct(*keys)).alias("h2"),
        *keys, value, F.when(F.col(value).isNotNull(), F.xxhash64(value)).alias("v"), F.coalesce(F.unix_micros("_when"), F.lit(-(1 << 62))).alias("w"),
    )
    w = Window.partitionBy("repo").orderBy("seq")
    snapshots = cut(df.select("repo", "seq").distinct())  # a row per snapshot; read once for the order and for the names
    index = snapshots.select("repo", "seq", (F.row_number().over(w) - 1).alias("idx"), F.lead("seq").over(w).alias("next_seq"))
    index = index.select(F.xxhash64("repo").alias("repo_h"), "seq", "idx", "next_seq")
    compact = hashed.select("repo_h", "seq", "h1", "h2", "v", "w")
    n = buckets_for(compact)
    arrays = compact.join(index, ["repo_h", "seq"]).withColumn("bucket", F.pmod(F.hash("h1", "h2"), F.lit(n)))
    found = cut(arrays.groupBy("bucket").applyInPandas(_bucket, _OUT))
    names = snapshots.select("repo").distinct().select("repo", F.xxhash64("repo").alias("repo_h"))
    totals = found.where("change = 'total'").groupBy("repo_h", "seq").agg(F.sum("n").alias("n")).join(names, "repo_h").select("repo", "seq", "n")
    full = hashed.select("repo_h", "repo", F.col("seq").alias("at_seq"), "h1", "h2", *keys, value, "w", "v")
    differing = found.where("change <> 'total'").drop("n")
    # few differing keys go to every task, so that the full rows stay where they are; many are met by a shuffle
    if differing.limit(FEW + 1).count() <= FEW:
        differing = F.broadcast(differing)
    hits = full.join(differing, ["repo_h", "at_seq", "h1", "h2"])
    order = F.struct("w", F.col("v").isNotNull(), "v")
    changes = hits.groupBy("repo", "seq", *keys, "change").agg(F.max_by(value, order).alias(value))
    return changes.withColumnsRenamed(names_of), totals


def file_changes(files: DataFrame) -> DataFrame:
    """Changes of the file snapshots; spelling of paths and hashes is settled first."""
    f = files.select("repo", "seq", clean_path(F.col("file_path")).alias("file_path"), clean_id(F.col("file_hash")).alias("file_hash"), "delivered_at")
    return snapshot_diff(f, ["file_path"], "file_hash", "delivered_at")[0]


SNIPPET_KEY = ["file_path", "qualname", "ordinal"]


def snippet_changes(scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of the snippet snapshots, and the number of snippets in each."""
    s = scans.select("repo", "seq", clean_path(F.col("file_path")).alias("file_path"), "qualname", "ordinal", clean_id(F.col("snippet_id")).alias("snippet_id"), "scanned_at")
    return snapshot_diff(s, SNIPPET_KEY, "snippet_id", "scanned_at")


def class_counts(changes: DataFrame, totals: DataFrame) -> DataFrame:
    """The five counts of each later snapshot: ``repo, seq, added, deleted, unchanged, modified, moved``.

    Added and removed records with the same content pair up one to one as moves. Contents are counted per snapshot
    before they are paired, so a content that countless files share costs no more than another.
    """
    is_ = lambda c: F.sum((F.col("change") == c).cast("long"))
    by_id = changes.groupBy("repo", "seq", "snippet_id").agg(is_("added").alias("f"), is_("removed").alias("g"), is_("changed").alias("m"))
    pair = F.when(F.col("snippet_id").isNull(), 0).otherwise(F.least("f", "g"))
    sums = by_id.groupBy("repo", "seq").agg(F.sum("f").alias("f"), F.sum("g").alias("g"), F.sum("m").alias("modified"), F.sum(pair).alias("moved"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return totals.join(sums, ["repo", "seq"], "left").select(
        "repo", "seq", (z("f") - z("moved")).alias("added"), (z("g") - z("moved")).alias("deleted"), (F.col("n") - z("f") - z("modified")).alias("unchanged"), z("modified").alias("modified"), z("moved").alias("moved")
    )


CLASSES = ["added", "deleted", "unchanged", "modified", "moved"]


def wrong_claims(versions: DataFrame, counts: DataFrame) -> DataFrame:
    """``repo, seq`` of versions after the first whose ``diff_json`` states a count that is not so.

    Only complete JSON objects and only numbers or numerals in them count; what is missing claims nothing.
    """
    claim = F.from_json("diff_json", "map<string,string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    whole = F.trim("diff_json").rlike(r"(?s)^\{.*\}$")
    v = versions.where("seq > 1").select("repo", "seq", F.when(whole, claim).alias("claim")).where("claim is not null")
    # the recorded value is a numeral if it casts; other words claim nothing
    number = lambda c: F.expr(f"try_cast(trim(claim['{c}']) as double)")
    wrong = F.lit(False)
    for c in CLASSES:
        wrong = wrong | F.coalesce(number(c) != F.col(c).cast("double"), F.lit(False))
    return v.join(counts, ["repo", "seq"]).where(wrong).select("repo", "seq").distinct()


def all_changes(files: DataFrame, scans: DataFrame, versions: DataFrame) -> DataFrame:
    """File, snippet and version findings in one table of seven columns."""
    changes, totals = snippet_changes(scans)
    cols = ["level", "repo", "seq", "file_path", "qualname", "ordinal", "change"]
    nothing = {"qualname": F.lit(""), "ordinal": F.lit(-1)}
    f = file_changes(files).withColumns({"level": F.lit("file"), **nothing}).select(cols)
    s = changes.withColumn("level", F.lit("snippet")).select(cols)
    bad = wrong_claims(versions, class_counts(changes, totals))
    v = bad.withColumns({"level": F.lit("version"), "file_path": F.lit(""), "change": F.lit("miscounted"), **nothing}).select(cols)
    return f.unionByName(s).unionByName(v)
