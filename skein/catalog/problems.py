"""Queries of the general problems 1 and 4."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, snapshots
from ..session import scratch_dir
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = history.lineage_periods(table(spark, d, "snippets"), table(spark, d, "versions"))
    return p.select("lineage_id", "snippet_id", F.col("seq_added").cast("int").alias("seq_added"), F.col("seq_removed").cast("int").alias("seq_removed"))


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    p = history.lineage_periods(table(spark, d, "snippets"), table(spark, d, "versions"))
    return p.select("lineage_id", *history.PLACE, "kind", "seq_added", "seq_removed")


def p1_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The state of every lineage at version 3, from the written store: the run's checkpoint and what follows it."""
    path = f"{scratch_dir(spark)}/history-{uuid.uuid4().hex}"
    history.save(history.lineage_store(table(spark, d, "snippets"), table(spark, d, "versions")), path)
    s = history.state_at(history.load(spark, path), history.KEY, history.ATTRS, 3)
    return s.select("lineage_id", *history.PLACE, "kind")


def p1_store_size(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of store row: how many rows, and how many attribute values they hold."""
    s = history.lineage_store(table(spark, d, "snippets"), table(spark, d, "versions"))
    slots = sum(F.col(f"patch.{a}").isNotNull().cast("long") for a in history.ATTRS)
    held = F.when(F.col("_kind") == 0, F.lit(len(history.ATTRS)).cast("long")).otherwise(slots)
    return s.groupBy(F.when(F.col("_kind") == 0, "checkpoint").otherwise("patch").alias("row_kind")).agg(F.count("*").alias("n"), F.sum(held).alias("n_values"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.all_changes(table(spark, d, "files"), table(spark, d, "snippet_scans"), table(spark, d, "versions"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = snapshots.class_counts(*snapshots.snippet_changes(table(spark, d, "snippet_scans")))
    return counts.select("repo", "seq", *[F.col(c).cast("long").alias(c) for c in snapshots.CLASSES])


_ROWS = """
labels as (select repo, lower(trim(version)) label, max(seq) seq from versions where version is not null group by 1, 2),
state as (
  select row_id, repo, lower(trim(snippet_id)) snippet_id, file_path, qualname, ordinal, kind, line_start, line_end, exported_at, seq_removed, nullif(lower(trim(version_removed)), '') label_removed,
         row_number() over (partition by row_id order by exported_at desc, (seq_removed is not null or nullif(trim(version_removed), '') is not null) desc, seq_removed desc nulls last) rn
  from snippets),
fixed as (select row_id, max(lineage_id) lineage_id, max(seq_added) sa, max(nullif(lower(trim(version_added)), '')) la from snippets group by 1),
rows as (
  select f.lineage_id, s.*, coalesce(f.sa, a.seq) seq_added, coalesce(s.seq_removed, r.seq) closed
  from state s join fixed f using (row_id)
  left join labels a on a.repo = s.repo and a.label = f.la left join labels r on r.repo = s.repo and r.label = s.label_removed
  where rn = 1),
marked as (
  select *, lag((snippet_id, file_path, qualname, ordinal)) over w was, lead(seq_added) over w nxt, last_value(closed) over (partition by lineage_id order by seq_added rows between unbounded preceding and unbounded following) last_closed
  from rows window w as (partition by lineage_id order by seq_added)),
starts as (select * from marked where was is null or was is distinct from (snippet_id, file_path, qualname, ordinal)),
periods as (
  select lineage_id, snippet_id, file_path, qualname, ordinal, kind, seq_added,
         coalesce(lead(seq_added) over (partition by lineage_id order by seq_added), last_closed, 0) seq_removed
  from starts)
"""

_DIFF = """
f0 as (
  select repo, seq, regexp_replace(regexp_replace(replace(trim(file_path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\\./)+', '') file_path,
         nullif(regexp_replace(lower(trim(file_hash)), '^sha-?256[:=]\\s*', ''), '') h, delivered_at from files),
f1 as (select *, row_number() over (partition by repo, seq, file_path order by delivered_at desc, h desc nulls last) rn from f0),
f2 as (select repo, seq, file_path, last_value(h ignore nulls) over (partition by repo, file_path order by seq) h from f1 where rn = 1),
fi as (select repo, seq, lag(seq) over (partition by repo order by seq) prev from (select distinct repo, seq from f2)),
fn as (select f2.*, fi.prev from f2 join fi using (repo, seq)),
fc as (
  select n.repo, n.seq, n.file_path, case when o.file_path is null then 'added' else 'changed' end change
  from fn n left join f2 o on o.repo = n.repo and o.seq = n.prev and o.file_path = n.file_path
  where n.prev is not null and (o.file_path is null or o.h <> n.h)
  union all
  select i.repo, i.seq, o.file_path, 'removed' from fi i join f2 o on o.repo = i.repo and o.seq = i.prev
  where not exists (select 1 from f2 n where n.repo = i.repo and n.seq = i.seq and n.file_path = o.file_path)),
s1 as (
  select repo, seq, file_path, qualname, ordinal, lower(trim(snippet_id)) sid,
         row_number() over (partition by repo, seq, file_path, qualname, ordinal order by scanned_at desc, lower(trim(snippet_id)) desc) rn from snippet_scans),
s2 as (select * from s1 where rn = 1),
si as (select repo, seq, lag(seq) over (partition by repo order by seq) prev from (select distinct repo, seq from s2)),
sn as (select s2.*, si.prev from s2 join si using (repo, seq)),
sc as (
  select n.repo, n.seq, n.file_path, n.qualname, n.ordinal, n.sid, case when o.sid is null then 'added' else 'changed' end change
  from sn n left join s2 o on o.repo = n.repo and o.seq = n.prev and o.file_path = n.file_path and o.qualname = n.qualname and o.ordinal = n.ordinal
  where n.prev is not null and (o.sid is null or o.sid <> n.sid)
  union all
  select i.repo, i.seq, o.file_path, o.qualname, o.ordinal, o.sid, 'removed' from si i join s2 o on o.repo = i.repo and o.seq = i.prev
  where not exists (select 1 from s2 n where n.repo = i.repo and n.seq = i.seq and n.file_path = o.file_path and n.qualname = o.qualname and n.ordinal = o.ordinal)),
by_id as (
  select repo, seq, sid, count(*) filter (change = 'added') f, count(*) filter (change = 'removed') g, count(*) filter (change = 'changed') m from sc group by 1, 2, 3),
sums as (select repo, seq, sum(f) f, sum(g) g, sum(m) m, sum(least(f, g)) mv from by_id group by 1, 2),
totals as (select repo, seq, count(*) n from s2 group by 1, 2),
counts as (
  select t.repo, t.seq, cast(coalesce(f, 0) - coalesce(mv, 0) as bigint) added, cast(coalesce(g, 0) - coalesce(mv, 0) as bigint) deleted,
         cast(n - coalesce(f, 0) - coalesce(m, 0) as bigint) unchanged, cast(coalesce(m, 0) as bigint) modified, cast(coalesce(mv, 0) as bigint) moved
  from totals t left join sums using (repo, seq))
"""

_CLAIM = " or ".join(f"coalesce(try_cast(trim(json_extract_string(diff_json, '$.{c}')) as double) <> {c}, false)" for c in snapshots.CLASSES)

QUERIES = {"p1_found": p1_found, "p1_history": p1_history, "p1_as_of": p1_as_of, "p1_store_size": p1_store_size, "p4_found": p4_found, "p4_counts": p4_counts}

ORACLE = {
    "p1_found": f"with {_ROWS} select lineage_id, snippet_id, cast(seq_added as integer) seq_added, cast(seq_removed as integer) seq_removed from periods",
    "p1_history": f"with {_ROWS} select lineage_id, snippet_id, file_path, qualname, ordinal, kind, seq_added, cast(seq_removed as integer) seq_removed from periods",
    "p1_as_of": f"with {_ROWS} select lineage_id, snippet_id, file_path, qualname, ordinal, kind from periods where seq_added <= 3 and (seq_removed = 0 or seq_removed > 3)",
    "p1_store_size": f"""with {_ROWS}, ev as (select lineage_id, seq_added seq, true live, row_id, snippet_id, file_path, qualname, ordinal, kind, line_start, line_end, repo, exported_at from rows
          union all select lineage_id, closed, false, row_id, snippet_id, file_path, qualname, ordinal, kind, line_start, line_end, repo, exported_at from rows where closed is not null),
        e1 as (select *, row_number() over (partition by lineage_id, seq order by live desc, exported_at desc, row_id desc) rn from ev),
        e2 as (select *, seq // 4 b, row_number() over w i, lag(seq // 4) over w pb from e1 where rn = 1 window w as (partition by lineage_id order by seq)),
        e3 as (select a.*, (select max(p.i) from e2 p where p.lineage_id is not distinct from a.lineage_id and p.live and p.i < a.i) pi from e2 a),
        e4 as (select a.*, p.i is null first, p.snippet_id ps, p.file_path pf, p.qualname pq, p.ordinal po, p.kind pk, p.line_start pl, p.line_end pe, p.repo pr from e3 a left join e2 p on p.lineage_id is not distinct from a.lineage_id and p.i = a.pi)
        select 'patch' row_kind, count(*) n, cast(sum(case when not live then 0 when first then 8 else cast(snippet_id is distinct from ps as integer) + cast(file_path is distinct from pf as integer) + cast(qualname is distinct from pq as integer)
          + cast(ordinal is distinct from po as integer) + cast(kind is distinct from pk as integer) + cast(line_start is distinct from pl as integer) + cast(line_end is distinct from pe as integer) + cast(repo is distinct from pr as integer) end) as bigint) n_values from e4
        union all select 'checkpoint', count(*), count(*) * 8 from e4 where not first and pb is distinct from b""",
    "p4_found": f"""with {_DIFF}
        select 'file' as level, repo, seq, file_path, '' qualname, -1 ordinal, change from fc
        union all select 'snippet', repo, seq, file_path, qualname, ordinal, change from sc
        union all select distinct 'version', repo, seq, '', '', -1, 'miscounted'
        from (select * from versions where seq > 1 and json_valid(diff_json)) v join counts using (repo, seq) where {_CLAIM}""",
    "p4_counts": f"with {_DIFF} select * from counts",
}
