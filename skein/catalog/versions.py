"""Queries of versions: differences, validity ranges, lineages, histories and upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import vector_id
from ..operators import diff, history as hist, lineage, metrics, snapshots, sparse
from ..plans.store import VersionedIndex
from ..session import scratch_dir, written
from ..sources.code_files import changed_files
from ..sources.tables import clean_id, clean_path, table
from . import problems

#: The versions that point-in-time queries ask for.
OLD, NEW = 2, 3


def _pairs(snapshots: DataFrame) -> DataFrame:
    """``repo, before, seq``: every snapshot of a repository with the nearest earlier one."""
    w = Window.partitionBy("repo").orderBy("seq")
    return snapshots.select("repo", "seq").distinct().select("repo", F.lag("seq").over(w).alias("before"), "seq").where("before is not null")


def _scans(spark, d, more=("kind", "language", "line_start", "line_end")):
    s = table(spark, d, "snippet_scans").where("repo is not null and seq is not null")
    sid = clean_id(F.col("snippet_id"))
    return s.groupBy("repo", "seq", *diff.KEY).agg(F.max_by(F.struct(sid.alias("snippet_id"), *more), F.struct("scanned_at", sid)).alias("l")).select("repo", "seq", *diff.KEY, "l.*")


def _diff(spark, d):
    """The classes of every version against the nearest earlier one of its repository, with the places of moves."""
    s, pairs = _scans(spark, d, ()), _pairs(table(spark, d, "snippet_scans").where("repo is not null and seq is not null"))
    old = s.withColumnRenamed("seq", "before").join(pairs, ["repo", "before"]).drop("before")
    return diff.diff_snippets(old, s.join(pairs.drop("before"), ["repo", "seq"]), ["repo", "seq"])


def diff_classes(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return diff.counts(_diff(spark, d), ["repo", "seq"])


def move_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).where("change_class = 'moved'").select("repo", "seq", "old_file_path", "old_qualname", "new_file_path", "new_qualname", F.col("new_snippet_id").alias("snippet_id"))


def _rows(spark, d):
    """The periods of all lineages as rows of a versioned index."""
    p = hist.lineage_periods(table(spark, d, "snippets"), table(spark, d, "versions"))
    return p.where("lineage_id is not null").select(
        (F.col("lineage_id") * 10000 + F.col("seq_added")).alias("row_id"), "lineage_id", "repo", "snippet_id", *lineage.PLACE, "kind", "line_start", "line_end",
        F.col("seq_added").cast("int").alias("seq_added"), F.when(F.col("seq_removed") > 0, F.col("seq_removed")).cast("int").alias("seq_removed"),
    )


_OUT = ["repo", "lineage_id", "snippet_id", "file_path", "qualname", "ordinal", "seq_added", "seq_removed"]


def scd2_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(_OUT)


def as_of(spark: SparkSession, d: str) -> DataFrame:
    return lineage.as_of(_rows(spark, d), NEW).select(_OUT)


def between_range(spark: SparkSession, d: str) -> DataFrame:
    return lineage.between(_rows(spark, d), OLD, NEW).select(_OUT)


def lineage_groups(spark: SparkSession, d: str) -> DataFrame:
    return lineage.groups(_rows(spark, d)).select("lineage_id", "n_versions", F.concat_ws(",", F.transform("versions", lambda v: v.cast("string"))).alias("versions"), "snippet_id", "file_path")


def _history(spark, d, rows):
    """Histories; a row that is valid now is so through the latest version of its repository."""
    last = table(spark, d, "versions").where("repo is not null").groupBy("repo").agg(F.max("seq").alias("last_seq"))
    return lineage.history(rows.join(last, "repo", "left"), last=F.col("last_seq"))


def history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d, _rows(spark, d)).select("lineage_id", "snippet_id", "seq_added", "version_no", "change", F.col("valid_through").cast("int").alias("valid_through"))


def history_diffs(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    many = rows.join(lineage.groups(rows).where("n_versions > 1").select("lineage_id"), "lineage_id", "left_semi")
    h = lineage.unified_diffs(_history(spark, d, many), table(spark, d, "snippet_text").select(clean_id(F.col("snippet_id")).alias("snippet_id"), "text"))
    return h.where("version_no > 1").select("lineage_id", "version_no", "change", "diff", "diff_note")


def history_diff_notes(spark: SparkSession, d: str) -> DataFrame:
    """Of ``history_diffs`` what SQL can tell: where a diff is missing, and where it is empty because nothing changed."""
    return history_diffs(spark, d).select("lineage_id", "version_no", F.col("diff_note").isNotNull().alias("missing"), (F.col("diff") == "").alias("empty"))


def lineage_backfill(spark: SparkSession, d: str) -> DataFrame:
    found = lineage.backfill(_rows(spark, d), ["repo"])
    return found.groupBy("new_lineage_id").agg(F.count("*").alias("n_rows"))


def vacuum_live(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "snippet_text").select(clean_id(F.col("snippet_id")).alias("snippet_id"))
    kept, gone = lineage.live_texts(t, _rows(spark, d), 4)
    return kept.withColumn("keep", F.lit(True)).unionByName(gone.withColumn("keep", F.lit(False)))


def lineage_links(spark: SparkSession, d: str) -> DataFrame:
    """The audit trail of edits."""
    h = lineage.history(_rows(spark, d)).where("change in ('modified', 'reverted')")
    return h.select(F.col("prev_snippet_id").alias("old_snippet_id"), F.col("snippet_id").alias("new_snippet_id"), "file_path", "qualname", F.col("seq_added").alias("seq"))


def _corpus(spark, d, rows):
    t = table(spark, d, "snippet_text").select(clean_id(F.col("snippet_id")).alias("snippet_id"), "vector_id", "text")
    return t.join(rows.select("snippet_id").distinct(), "snippet_id", "left_semi")


def _asks(spark, d):
    return table(spark, d, "snippet_text").where("vector_id % 100 = 0").select(F.col("vector_id").alias("query_id"), "text")


def bm25_as_of(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d, lineage.as_of(_rows(spark, d), NEW))
    return sparse.search(sparse.build(corpus, "vector_id", "text"), _asks(spark, d), "query_id", "text", 10)


def _lists(spark, d, rows):
    """``ranked_at(n, asks)``, the best ``n`` texts of ``rows`` for each question; the questions, ``rows`` with the ids of
    their texts, and how many texts there are."""
    rows, asks = written(rows, "rows"), written(_asks(spark, d), "asks")
    # texts are counted as they come; only their ids are kept
    corpus = _corpus(spark, d, rows)
    ids = written(corpus.select("snippet_id", "vector_id"), "ids")
    index, size = sparse.build(corpus, "vector_id", "text"), ids.count()
    placed = written(rows.join(ids, "snippet_id", "left"), "placed")  # vacuumed texts are versions too
    return lambda n, some=asks: written(sparse.search(index, some, "query_id", "text", min(n, max(size, 1))), "ranked"), asks, placed, size


def _grouped(spark, d, rows, k=10):
    """Grouped and ungrouped results over the texts of ``rows``; lists double for queries that lack lineages."""
    ranked_at, asks, placed, size = _lists(spark, d, rows)
    first = ranked_at(4 * k)
    longer = lambda n, some: first if n == 4 * k else ranked_at(n, some)
    return lineage.widened(longer, asks, placed, k, 4 * k, size, steady=True), first.where(F.col("rank") <= k), placed


def lineage_search_grouped(spark: SparkSession, d: str) -> DataFrame:
    g = _grouped(spark, d, lineage.between(_rows(spark, d), OLD, NEW))[0]
    return g.select("query_id", "rank", "score", "lineage_id", "n_versions", "matched_seq", "matched_snippet_id", "matched_differs")


def lineage_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """Ungrouped searches over all versions: slots that further versions of one lineage take."""
    ranked_at, _, placed, _ = _lists(spark, d, _rows(spark, d))
    return metrics.redundancy(ranked_at(10).join(placed.select(F.col("vector_id").alias("id"), "lineage_id"), "id"))


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Over all versions, grouped and ungrouped: queries whose own file is found, lineages that grouping lost, results
    that matched on an older wording."""
    grouped, raw, placed = _grouped(spark, d, _rows(spark, d))
    at = F.concat_ws("/", "repo", "file_path").alias("file_path")
    hits = raw.join(placed.select(F.col("vector_id").alias("id"), "lineage_id", "row_id", at), "id")
    # as slots are places, an ungrouped list holds the places of its best texts up to k
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "file_path", "row_id"))
    hits = written(hits.withColumn("slot", slot).where("slot <= 10"), "hits")
    latest = placed.groupBy("lineage_id").agg(F.max_by(F.concat_ws("/", "repo", "file_path"), F.struct("seq_added", "row_id")).alias("file_path"))
    grouped = written(grouped, "grouped")
    shown = grouped.select("query_id", "lineage_id").join(latest, "lineage_id")
    targets = placed.where("vector_id % 100 = 0").select(F.col("vector_id").alias("query_id"), at).distinct()
    rate = lambda r, name: metrics.hit_rate(metrics.hits(r, targets)).withColumnsRenamed({"n_hits": f"hits_{name}", "hit_rate": f"rate_{name}"})
    lost = metrics.lost_lineages(hits, grouped).agg(F.count("*").alias("queries_with_loss"))
    older = grouped.agg(F.coalesce(F.sum(F.col("matched_differs").cast("long")), F.lit(0)).alias("matched_older"))
    # four single rows
    return rate(hits, "ungrouped").join(rate(shown, "grouped").drop("n_queries")).join(lost).join(older)


def versions_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.versions_histogram(_rows(spark, d))


def file_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.file_changes(table(spark, d, "files")).select("repo", "seq", "file_path", "change")


def changed_listing(spark: SparkSession, d: str) -> DataFrame:
    """Changed files of every listing against the one delivered before it; a null hash is a hash like others here."""
    f = table(spark, d, "files").where("repo is not null and seq is not null")
    f = f.select("repo", "seq", clean_path(F.col("file_path")).alias("file_path"), clean_id(F.col("file_hash")).alias("file_hash"), "delivered_at")
    f = f.groupBy("repo", "seq", "file_path").agg(F.max_by("file_hash", F.struct("delivered_at", "file_hash")).alias("file_hash"))
    pairs = _pairs(table(spark, d, "files").where("repo is not null and seq is not null"))
    old = f.withColumnRenamed("seq", "before").join(pairs, ["repo", "before"]).drop("before")
    return changed_files(old, f.join(pairs.drop("before"), ["repo", "seq"]), ["repo", "seq"])


def ranges_and_scans(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: records of the last full scan, rows that the ranges hold valid, and how many of them are the same."""
    scans = _scans(spark, d, ())
    last = table(spark, d, "snippet_scans").where("repo is not null").groupBy("repo").agg(F.max("seq").alias("seq"))
    full = scans.join(last, ["repo", "seq"]).select("repo", *diff.KEY, "snippet_id", F.lit(1).alias("s"), F.lit(0).alias("r"))
    kept = _rows(spark, d).where("seq_removed is null").select("repo", *diff.KEY, "snippet_id", F.lit(0).alias("s"), F.lit(1).alias("r"))
    both = full.unionByName(kept).groupBy("repo", *diff.KEY, "snippet_id").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    return both.groupBy("repo").agg(F.sum("s").alias("n_scanned"), F.sum("r").alias("n_valid"), F.sum(F.least("s", "r")).alias("n_same"))


_STORES: dict[tuple[str, str], VersionedIndex] = {}


def _store(spark, d) -> VersionedIndex:
    """All repositories in one store: version ``v<n>`` holds of each its latest scan up to n. Made once a session.

    Each version goes through the incremental writer: a file's hash is that of its records, so only files that changed
    are read, and only texts that are new are embedded.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        ix = VersionedIndex(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
        path = F.concat_ws("/", "repo", "file_path").alias("file_path")
        record = F.xxhash64("qualname", "ordinal", "snippet_id", "kind", "line_start", "line_end").alias("h")
        scans = written(_scans(spark, d).select("repo", "seq", path, "qualname", "ordinal", "kind", "language", "line_start", "line_end", "snippet_id", record), "scans")
        # the listings of all scans, each with the scan of its repository that replaces it
        turns = scans.select("repo", "seq").distinct().withColumn("until", F.lead("seq").over(Window.partitionBy("repo").orderBy("seq")))
        listed = scans.groupBy("repo", "seq", "file_path").agg(F.hex(F.sum(F.col("h").cast("decimal(38,0)")).cast("string")).alias("file_hash"))
        listed = written(listed.join(turns, ["repo", "seq"]).select("seq", "until", "file_path", "file_hash"), "listed")
        texts = table(spark, d, "snippet_text").select(clean_id(F.col("snippet_id")).alias("snippet_id"), "text")
        seqs = [r["seq"] for r in listed.select("seq").distinct().orderBy("seq").collect()]  # a handful of versions
        for n in seqs:
            files = listed.where((F.col("seq") <= n) & (F.col("until").isNull() | (F.col("until") > n))).select("file_path", "file_hash")
            # a file changes only with a scan of its repository
            now = scans.where(F.col("seq") == n)
            ix.index_snippets(files, lambda paths, now=now: now.join(paths, "file_path", "left_semi"), f"v{n}", texts=texts)
        _STORES[key] = ix
    return _STORES[key]


def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """What the incremental writer counted for each version."""
    counts = F.from_json("diff_json", ", ".join(f"{c} long" for c in snapshots.CLASSES))
    return _store(spark, d).versions().select("seq", "version", "n_files", "n_snippets", counts.alias("c")).select("seq", "version", "n_files", "n_snippets", "c.*")


def store_rows(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).table("rows").select("file_path", "qualname", "ordinal", "snippet_id", "line_start", "version_added", "version_removed", "seq_added", "seq_removed")


def store_links(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).lineage()


def store_search(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of one version of the store, as shipped: every place of the best texts."""
    asks = _asks(spark, d)
    found = _store(spark, d).search_many(asks, 10, as_of=f"v{NEW}")
    return found.select("query_id", "rank", F.round("score", 6).alias("score"), "file_path", "qualname", "ordinal", "version_added", "valid_through")


def store_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of every lineage of the store, with labels."""
    h = _store(spark, d).history(None)
    return h.select("file_path", "qualname", "ordinal", "snippet_id", "version_added", "valid_through")


QUERIES = {
    f.__name__: f
    for f in (
        diff_classes, diff_counts, move_pairs, scd2_rows, as_of, between_range, lineage_groups, history, history_diffs, history_diff_notes, lineage_backfill, vacuum_live, lineage_links, bm25_as_of,
        lineage_search_grouped, lineage_redundancy, search_hits, versions_histogram, file_changes, changed_listing, ranges_and_scans, store_versions, store_rows, store_links, store_search, store_history,
    )
}

_SCAN = """
s1 as (select repo, seq, file_path, qualname, ordinal, kind, line_start, lower(trim(snippet_id)) sid, row_number() over (partition by repo, seq, file_path, qualname, ordinal order by scanned_at desc, lower(trim(snippet_id)) desc) rn
  from snippet_scans where repo is not null and seq is not null),
sq as (select repo, seq, lag(seq) over w before, lead(seq) over w after, row_number() over w i from (select distinct repo, seq from s1) window w as (partition by repo order by seq))"""
_ALL = _SCAN + """,
o as (select s1.repo, sq.after seq, file_path, qualname, ordinal, sid from s1 join sq on s1.repo = sq.repo and s1.seq = sq.seq where rn = 1 and after is not null),
n as (select s1.repo, s1.seq, file_path, qualname, ordinal, sid from s1 join sq on s1.repo = sq.repo and s1.seq = sq.seq where rn = 1 and before is not null),
j as (select coalesce(o.repo, n.repo) repo, coalesce(o.seq, n.seq) seq, o.file_path of, o.qualname oq, o.ordinal oo, o.sid os, n.file_path nf, n.qualname nq, n.ordinal no, n.sid ns
  from o full outer join n on o.repo = n.repo and o.seq = n.seq and o.file_path = n.file_path and o.qualname = n.qualname and o.ordinal = n.ordinal),
gone as (select *, row_number() over (partition by repo, seq, os order by of, oq, oo) rn from j where nf is null),
fresh as (select *, row_number() over (partition by repo, seq, ns order by nf, nq, no) rn from j where of is null),
cls as (select repo, seq, case when os = ns then 'unchanged' else 'modified' end c, of, oq, oo, os, nf, nq, no, ns from j where of is not null and nf is not null
  union all select coalesce(g.repo, f.repo), coalesce(g.seq, f.seq), case when f.nf is null then 'deleted' when g.of is null then 'added' else 'moved' end, g.of, g.oq, g.oo, g.os, f.nf, f.nq, f.no, f.ns
  from gone g full outer join fresh f on g.repo = f.repo and g.seq = f.seq and g.os = f.ns and g.rn = f.rn)
"""
# all repositories in one store: a version holds of each repository its latest scan, so between scans nothing changes
_STORE = _SCAN + """,
scn as (select s1.repo, s1.seq, s1.repo || '/' || file_path path, qualname, ordinal, kind, line_start, sid, i, after from s1 join sq on s1.repo = sq.repo and s1.seq = sq.seq where rn = 1),
run as (select *, i - row_number() over (partition by path, qualname, ordinal, sid order by i) g from scn),
st as (select path, qualname, ordinal, sid, min(seq) sa, arg_max(struct_pack(a := after), i).a sr, arg_max(line_start, i) ls from run group by path, qualname, ordinal, sid, g)"""
_TURNS = _STORE + """,
vs as (select distinct seq from scn),
j as (select coalesce(a.sa, b.sr) seq, b.path op, b.qualname oq, b.ordinal oo, b.sid os, a.path np, a.qualname nq, a.ordinal no, a.sid ns
  from st a full outer join (select * from st where sr is not null) b on a.sa = b.sr and a.path = b.path and a.qualname = b.qualname and a.ordinal = b.ordinal),
gone as (select *, row_number() over (partition by seq, os order by op, oq, oo) rn from j where np is null),
fresh as (select *, row_number() over (partition by seq, ns order by np, nq, no) rn from j where op is null),
tc as (select seq, 'modified' c, os, ns, np, nq from j where op is not null and np is not null
  union all select coalesce(g.seq, f.seq), case when f.np is null then 'deleted' when g.op is null then 'added' else 'moved' end, g.os, f.ns, f.np, f.nq
  from gone g full outer join fresh f on g.seq = f.seq and g.os = f.ns and g.rn = f.rn)"""
_P = f"""{problems._ROWS}, p as (select *, nullif(seq_removed, 0) sr, lineage_id * 10000 + seq_added row_id, (select any_value(r.repo) from rows r where r.lineage_id = periods.lineage_id) repo from periods where lineage_id is not null)"""
_SEL = "select repo, lineage_id, snippet_id, file_path, qualname, ordinal, seq_added, cast(sr as integer) seq_removed from p"
_H = """h as (select *, row_number() over w nth, lag(snippet_id) over w prev, row_number() over (partition by lineage_id, snippet_id order by seq_added) > 1 seen from p window w as (partition by lineage_id order by seq_added)),
hc as (select *, case when nth = 1 then 'added' when prev = snippet_id then 'moved' when seen then 'reverted' else 'modified' end change from h)"""


_GROUPED = """hits as (select query_id, l.score, l.rank, v.*, (select any_value(line_start) from rows r where r.lineage_id = v.lineage_id and r.seq_added = v.seq_added) ls
          from lex l join snippet_text t on t.vector_id = l.id join valid v on v.snippet_id = t.snippet_id),
        best as (select *, row_number() over (partition by query_id, lineage_id order by rank, file_path, ls, row_id) b from hits),
        top as (select *, row_number() over (partition by query_id order by rank, file_path, ls, row_id) pos from best where b = 1),
        g as (select lineage_id, count(*) n_versions, arg_max(snippet_id, seq_added) shown, arg_max(file_path, seq_added) place, any_value(repo) repo from valid group by 1)"""


def _store_lists() -> str:
    """Lexical and dense lists over the distinct texts of ``valid``, fused as shipped."""
    from .retrieval import _BOW, _INDEX, _fused

    docs = "docs as (select distinct vid doc_id, text from valid left join snippet_text using (snippet_id)), asks as (select vector_id query_id, text from snippet_text where vector_id % 100 = 0)"
    bow = _BOW[_BOW.index("wd as") : _BOW.index("dots as")]
    asked = bow.replace("wd as", "qw as").replace("bk as", "qb as").replace("nm as", "qn as").replace("bv as", "qv as").replace("doc_id", "query_id").replace("from docs", "from asks").replace("from wd", "from qw").replace("from bk", "from qb").replace("join nm", "join qn")
    near = """dots as (select q.query_id, v.doc_id id, sum(q.x * v.x) s from qv q join bv v using (b) group by 1, 2),
allp as (select asks.query_id, docs.doc_id id, round(coalesce(s, 0.0), 6) score from asks cross join docs left join dots on dots.query_id = asks.query_id and dots.id = docs.doc_id),
near as (select *, row_number() over (partition by query_id order by score desc, id) as rank from allp)"""
    return f"{docs}{_INDEX[_INDEX.index(',\ntok as'):]}, {bow} {asked} {near}, {_fused(100, 0.3)}"


def _bm25(rows: str) -> str:
    from ..functions.text import CODE_TOKENS_SQL
    from .retrieval import _INDEX

    head = f"docs as (select vector_id doc_id, text from snippet_text where snippet_id in (select snippet_id from {rows})), asks as (select vector_id query_id, text from snippet_text where vector_id % 100 = 0)"
    return head + _INDEX[_INDEX.index(",\ntok as") :]


ORACLE = {
    "diff_classes": f"with {_ALL} select repo, seq, c change_class, of old_file_path, oq old_qualname, oo old_ordinal, os old_snippet_id, nf new_file_path, nq new_qualname, no new_ordinal, ns new_snippet_id from cls",
    "diff_counts": f"""with {_ALL} select repo, seq, count(*) filter (c = 'added') added, count(*) filter (c = 'deleted') deleted, count(*) filter (c = 'unchanged') unchanged,
        count(*) filter (c = 'modified') modified, count(*) filter (c = 'moved') moved from cls group by 1, 2""",
    "move_pairs": f"with {_ALL} select repo, seq, of old_file_path, oq old_qualname, nf new_file_path, nq new_qualname, ns snippet_id from cls where c = 'moved'",
    "scd2_rows": f"with {_P} {_SEL}",
    "as_of": f"with {_P} {_SEL} where seq_added <= {NEW} and (sr is null or sr > {NEW})",
    "between_range": f"with {_P} {_SEL} where seq_added <= {NEW} and (sr is null or sr > {OLD})",
    "lineage_groups": f"with {_P} select lineage_id, count(*) n_versions, string_agg(cast(seq_added as varchar), ',' order by seq_added) versions, arg_max(snippet_id, seq_added) snippet_id, arg_max(file_path, seq_added) file_path from p group by 1",
    "history": f"with {_P}, {_H}, lv as (select repo, max(seq) top from versions where repo is not null group by 1) select lineage_id, snippet_id, seq_added, cast(nth as integer) version_no, change, cast(coalesce(sr - 1, top) as integer) valid_through from hc left join lv using (repo)",
    "history_diff_notes": f"""with {_P}, {_H}, x as (select lineage_id, nth, tp.text a, tn.text b from hc left join snippet_text tp on tp.snippet_id = hc.prev left join snippet_text tn on tn.snippet_id = hc.snippet_id where nth > 1)
        select lineage_id, cast(nth as integer) version_no, a is null or b is null missing, a = b empty from x""",
    "lineage_backfill": f"with {_P} select min(row_id) new_lineage_id, count(*) n_rows from p group by lineage_id",
    "vacuum_live": f"with {_P}, live as (select distinct snippet_id from p where sr is null or sr > 4) select t.snippet_id, live.snippet_id is not null keep from snippet_text t left join live using (snippet_id)",
    "lineage_links": f"with {_P}, {_H} select prev old_snippet_id, snippet_id new_snippet_id, file_path, qualname, seq_added seq from hc where change in ('modified', 'reverted')",
    "bm25_as_of": f"with {_P}, valid as (select * from p where seq_added <= {NEW} and (sr is null or sr > {NEW})), {_bm25('valid')} select * from lex where rank <= 10",
    "lineage_search_grouped": f"""with {_P}, valid as (select * from p where seq_added <= {NEW} and (sr is null or sr > {OLD})), {_bm25('valid')}, {_GROUPED}
        select query_id, cast(pos as integer) as rank, score, lineage_id, n_versions, seq_added matched_seq, snippet_id matched_snippet_id, snippet_id <> shown matched_differs from top join g using (lineage_id) where pos <= 10""",
    "search_hits": f"""with {_P}, valid as (select * from p), {_bm25('valid')}, {_GROUPED},
        grp as (select t.query_id, t.lineage_id, t.snippet_id <> g.shown differs, g.repo || '/' || g.place path from top t join g using (lineage_id) where pos <= 10),
        rw as (select * from (select query_id, lineage_id, repo || '/' || file_path path, row_number() over (partition by query_id order by rank, repo || '/' || file_path, row_id) slot from hits where rank <= 10) where slot <= 10),
        tg as (select distinct t.vector_id query_id, p.repo || '/' || p.file_path path from p join snippet_text t on t.snippet_id = p.snippet_id where t.vector_id % 100 = 0),
        hu as (select tg.query_id, max(cast(rw.path is not null as integer)) h from tg left join rw on rw.query_id = tg.query_id and rw.path = tg.path group by 1),
        hg as (select tg.query_id, max(cast(grp.path is not null as integer)) h from tg left join grp on grp.query_id = tg.query_id and grp.path = tg.path group by 1)
        select (select count(*) from hu) n_queries, cast((select sum(h) from hu) as bigint) hits_ungrouped, (select round(avg(h), 6) from hu) rate_ungrouped, cast((select sum(h) from hg) as bigint) hits_grouped, (select round(avg(h), 6) from hg) rate_grouped,
          (select count(distinct query_id) from rw where not exists (select 1 from grp where grp.query_id = rw.query_id and grp.lineage_id = rw.lineage_id)) queries_with_loss, (select count(*) from grp where differs) matched_older""",
    "versions_histogram": f"with {_P}, per as (select lineage_id, count(*) n_versions from p group by 1) select n_versions, count(*) n_lineages from per group by 1",
    "lineage_redundancy": f"""with {_P}, {_bm25('p')},
        q as (select query_id, count(*) n, count(distinct p.lineage_id) d from lex l join snippet_text t on t.vector_id = l.id join p on p.snippet_id = t.snippet_id where l.rank <= 10 group by 1)
        select count(*) n_queries, round(avg(n), 6) mean_slots, round(avg(d), 6) mean_distinct, round(avg(n - d), 6) mean_wasted, round(sum(n - d) / sum(n), 6) wasted_share,
          round(avg(cast(n - d >= 1 as integer)), 6) share_wasting, round(avg(cast(n - d >= 3 as integer)), 6) share_wasting_3 from q""",
    "file_changes": f"with {problems._DIFF} select repo, seq, file_path, change from fc",
    "changed_listing": f"""with {problems._DIFF}, a as (select repo, seq, file_path, h from f1 where rn = 1), li as (select repo, seq, lag(seq) over (partition by repo order by seq) prev, lead(seq) over (partition by repo order by seq) nxt from (select distinct repo, seq from a)),
        o as (select a.repo, li.nxt seq, file_path, h from a join li on li.repo = a.repo and li.seq = a.seq where nxt is not null), n as (select a.repo, a.seq, file_path, h from a join li on li.repo = a.repo and li.seq = a.seq where prev is not null)
        select coalesce(o.repo, n.repo) repo, coalesce(o.seq, n.seq) seq, coalesce(o.file_path, n.file_path) file_path, case when o.repo is null then 'new' when n.repo is null then 'removed' else 'edited' end change
        from o full outer join n on o.repo = n.repo and o.seq = n.seq and o.file_path = n.file_path where o.repo is null or n.repo is null or o.h is distinct from n.h""",
    "ranges_and_scans": f"""with {_P}, sc as (select repo, file_path, qualname, ordinal, lower(trim(snippet_id)) snippet_id, row_number() over (partition by repo, seq, file_path, qualname, ordinal order by scanned_at desc, lower(trim(snippet_id)) desc) rn, seq, max(seq) over (partition by repo) top from snippet_scans where repo is not null),
        f as (select repo, file_path, qualname, ordinal, snippet_id from sc where rn = 1 and seq = top), k as (select repo, file_path, qualname, ordinal, snippet_id from p where sr is null),
        same as (select repo, count(*) n from (select * from f intersect all select * from k) group by 1), fn as (select repo, count(*) n from f group by 1), kn as (select repo, count(*) n from k group by 1)
        select coalesce(fn.repo, kn.repo) repo, coalesce(fn.n, 0) n_scanned, coalesce(kn.n, 0) n_valid, coalesce(same.n, 0) n_same from fn full outer join kn on fn.repo = kn.repo left join same on same.repo = coalesce(fn.repo, kn.repo)""",
    "store_rows": f"with {_STORE} select path file_path, qualname, ordinal, sid snippet_id, ls line_start, 'v' || sa version_added, 'v' || sr version_removed, sa seq_added, sr seq_removed from st",
    "store_history": f"with {_STORE} select path file_path, qualname, ordinal, sid snippet_id, 'v' || sa version_added, 'v' || coalesce(sr - 1, (select max(seq) from scn)) valid_through from st",
    "store_links": f"with {_TURNS} select os old_snippet_id, ns new_snippet_id, np file_path, nq qualname, 'v' || seq as version from tc where c = 'modified'",
    "store_versions": f"""with {_TURNS},
        here as (select vs.seq, count(*) n, count(distinct path) f from vs join st on st.sa <= vs.seq and (st.sr is null or st.sr > vs.seq) group by 1),
        k as (select seq, count(*) filter (c = 'added') added, count(*) filter (c = 'deleted') deleted, count(*) filter (c = 'modified') modified, count(*) filter (c = 'moved') moved from tc group by 1)
        select cast(here.seq as integer) seq, 'v' || here.seq as version, f n_files, n n_snippets, coalesce(added, 0) added, coalesce(deleted, 0) deleted, n - coalesce(added, 0) - coalesce(modified, 0) - coalesce(moved, 0) unchanged, coalesce(modified, 0) modified, coalesce(moved, 0) moved
        from here left join k using (seq)""",
    "store_search": f"""with {_STORE}, valid as (select *, sid snippet_id, cast(cast('0x' || sid as ubigint) // 2 as bigint) vid from st where sa <= {NEW} and (sr is null or sr > {NEW})), {_store_lists()}
        select fu.query_id, cast(fu.rank as integer) as rank, round(fu.score, 6) score, v.path file_path, v.qualname, v.ordinal, 'v' || v.sa version_added, 'v' || coalesce(v.sr - 1, (select max(seq) from scn)) valid_through
        from fu join valid v on v.vid = fu.id where fu.rank <= 10""",
}
