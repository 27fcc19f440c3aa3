"""Attribute history and snapshot differences against brute force, and their defined edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import history, snapshots

SNIP = "row_id long, repo string, snippet_id string, content_hash string, file_path string, qualname string, kind string, language string, ordinal int, line_start int, line_end int, version_added string, version_removed string, seq_added int, seq_removed int, lineage_id long, exported_at timestamp"
VERS = "repo string, seq int, version string"
T0 = dt.datetime(2024, 1, 1)


def upd(row, lin, sid, a, r=None, va=None, vr=None, at=0, place="a.py", repo="r", line=1):
    return (row, repo, sid, sid, place, "f", "function", "python", 0, line, line + 1, va, vr, a, r, lin, T0 + dt.timedelta(hours=at))


def run(spark, rows, versions=()):
    out = history.lineage_periods(spark.createDataFrame(rows, SNIP), spark.createDataFrame(list(versions), VERS))
    return sorted((x["lineage_id"], x["snippet_id"], x["seq_added"], x["seq_removed"]) for x in out.collect())


def test_periods_of_dirty_updates(spark):
    versions = [("r", i, f"v{i}") for i in range(1, 9)]
    rows = [
        upd(1, 10, "aa", 1), upd(1, 10, "AA ", 1, 3, at=1), upd(1, 10, "aa", 1),  # closed later, repeated, spelled otherwise
        upd(2, 10, "bb", None, None, va=" V3 ", at=1),  # start only as a label; the closing update is missing
        upd(3, 10, "bb", 5, None, at=2, line=9),  # the same place and content: no new period
        upd(4, None, "cc", 7, None, at=3), upd(4, 10, "cc", 7, None, vr="v8", at=4),  # lineage and end from other updates
    ]
    assert run(spark, rows, versions) == [(10, "aa", 1, 3), (10, "bb", 3, 7), (10, "cc", 7, 8)]


def test_correction_and_empty_label(spark):
    rows = [upd(1, 1, "aa", 1, 4, at=1), upd(1, 1, "aa", 1, 5, at=2), upd(2, 2, "bb", 1, None, vr="", at=0)]
    assert run(spark, rows) == [(1, "aa", 1, 5), (2, "bb", 1, 0)]


def test_no_lineage_null_fields_and_empty(spark):
    assert run(spark, []) == []
    rows = [upd(7, None, "aa", 2), upd(8, None, None, None), upd(None, 3, "x", 1)]
    got = run(spark, rows[:1]) + run(spark, rows[2:])
    assert got == [(None, "aa", 2, 0), (3, "x", 1, 0)]
    assert run(spark, rows[1:2]) == [(None, None, None, 0)]


@pytest.mark.parametrize("every", [1, 3, 16])
def test_replay_equals_states(spark, every):
    rng = random.Random(every)
    rows = []
    for key in range(12):
        for seq in sorted(rng.sample(range(1, 60), rng.randint(1, 25))):
            rows.append((key, seq, True, rng.choice(["a", "b", None]), rng.choice([1, 2, None])))
    ev = spark.createDataFrame(rows, "k int, seq int, live boolean, x string, y int")
    store = history.build_store(ev, ["k"], ["x", "y"], every)
    back = history.replay(store, ["k"], ["x", "y"]).where("_kind = 1").select("k", "seq", "x", "y").collect()
    assert sorted(map(repr, [tuple(r) for r in back])) == sorted(repr((k, s, x, y)) for k, s, _, x, y in rows)
    patches = store.where("_kind = 1")
    kept = patches.agg(F.sum(F.col("patch.x").isNotNull().cast("int") + F.col("patch.y").isNotNull().cast("int"))).first()[0]
    assert kept < 2 * len(rows) or every == 1


def brute(rows):
    """rows: repo, seq, key, value, when"""
    snaps, last_known = {}, {}
    best = {}
    for repo, seq, key, val, when in rows:
        if best.get((repo, seq, key), (None, -1))[1] < when:
            best[repo, seq, key] = (val, when)
    for (repo, seq, key), (val, _) in sorted(best.items(), key=lambda x: x[0][1]):
        if val is None:
            val = last_known.get((repo, key))
        else:
            last_known[repo, key] = val
        snaps.setdefault(repo, {}).setdefault(seq, {})[key] = val
    out = set()
    for repo, by in snaps.items():
        seqs = sorted(by)
        for p, s in zip(seqs, seqs[1:]):
            a, b = by[p], by[s]
            out |= {(repo, s, k, "added") for k in b.keys() - a.keys()} | {(repo, s, k, "removed") for k in a.keys() - b.keys()}
            out |= {(repo, s, k, "changed") for k in a.keys() & b.keys() if a[k] is not None and b[k] is not None and a[k] != b[k]}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapshot_diff_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, when = [], 0
    for repo in ("p", "q"):
        for seq in rng.sample(range(1, 12), 6):
            for key in rng.sample("abcdefghij", rng.randint(1, 9)):
                for _ in range(rng.choice([1, 1, 2])):
                    when += 1
                    rows.append((repo, seq, key, rng.choice(["x", "y", "z", None]), when))
    rng.shuffle(rows)
    df = spark.createDataFrame([(r, s, k, v, T0 + dt.timedelta(seconds=w), 5, "n") for r, s, k, v, w in rows], "repo string, seq int, k string, v0 string, t timestamp, idx int, bucket string")
    changes, totals = snapshots.snapshot_diff(df, ["k"], "v0", "t")
    assert {tuple(r) for r in changes.select("repo", "seq", "k", "change").collect()} == brute(rows)
    assert sum(r["n"] for r in totals.collect()) == len({(r, s, k) for r, s, k, _, _ in rows})


def test_snapshot_diff_edges(spark):
    schema = "repo string, seq int, k string, v string, t timestamp"
    empty, _ = snapshots.snapshot_diff(spark.createDataFrame([], schema), ["k"], "v", "t")
    assert empty.count() == 0
    rows = [("r", 1, None, "a", T0), ("r", 2, None, "b", None), ("r", 2, None, "b", None), (None, 1, "x", "y", T0), ("r", None, "x", "y", T0), ("r", 4, "z", None, T0)]
    got, _ = snapshots.snapshot_diff(spark.createDataFrame(rows, schema), ["k"], "v", "t")
    assert {tuple(r) for r in got.select("seq", "k", "change").collect()} == {(2, None, "changed"), (4, None, "removed"), (4, "z", "added")}
    none = np.zeros(0, np.int64)
    assert all(len(v) == 0 for v in snapshots.diff_arrays(none, none, none, none, none, none, none.astype(bool)).values())


def test_claims(spark):
    v = [("r", 2, '{"added": 1, "deleted": "0"}'), ("r", 3, '{"added": "2"}'), ("r", 4, '{"added": 9'), ("r", 5, None), ("r", 6, '{"added": "many"}'), ("r", 1, '{"added": 7}'), ("r", 3, '{"added": "2"}')]
    versions = spark.createDataFrame(v, "repo string, seq int, diff_json string")
    counts = spark.createDataFrame([("r", i, 1, 0, 5, 0, 0) for i in range(1, 7)], "repo string, seq int, added long, deleted long, unchanged long, modified long, moved long")
    assert [tuple(r) for r in snapshots.wrong_claims(versions, counts).collect()] == [("r", 3)]
