"""Work and disk of searches that grow with their tables."""

import time

import numpy as np
from pyspark.sql import functions as F

from skein import session
from skein.catalog import retrieval, versions
from skein.operators import dense, lineage, ranking, sparse
from skein.plans import store


def test_best_of_blocks_with_ties():
    rng = np.random.default_rng(5)
    s = np.round(rng.integers(0, 40, (6, 90)) / 7, 6) + rng.choice([0, 2e-7], (6, 90))
    for k in (1, 4, 50, 200):
        best = ranking.Best(6, k, 4e-7)
        for a in (0, 30, 60):  # queries in two parts, ids out of order
            for at in (0, 3):
                best.add(s[at : at + 3, a : a + 30], np.arange(a, a + 30) * 7 % 97, at)
        got = sorted(zip(*(x.tolist() for x in best.take())))
        want = sorted((q, i, v) for q in range(6) for v, i in [(-v, i) for v, i in sorted((-round(s[q, j], 6), j * 7 % 97) for j in range(90)) if v < 0][:k])
        assert got == want, k


def test_search_shuffles_results_only(spark):
    """Lists of terms and postings stay where they are: of the scoring only its best are exchanged."""
    df = spark.createDataFrame([(i, f"common w{i % 5}") for i in range(40)], "id long, text string")
    plan = sparse.search(sparse.build(df, "id", "text"), df, "id", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(query_id" in plan


def test_widening_asks_only_who_lacks(spark):
    """Query 1 has its lineages at once, 2 has no more texts, 3 needs a longer list."""
    lists = {1: [(10, 5.0), (11, 4.0), (12, 3.0)], 2: [(10, 2.0)], 3: [(20, 9.0), (21, 8.0), (10, 7.0)]}
    ranked = spark.createDataFrame([(q, i, s, n + 1) for q, x in lists.items() for n, (i, s) in enumerate(x)], "query_id long, id long, score double, rank int")
    rows = spark.createDataFrame([(i, 1 if i > 19 else i, i, f"s{i}", "f", "g", 0, 1, i, None) for i in (10, 11, 12, 20, 21)], "row_id long, lineage_id long, vector_id long, snippet_id string, file_path string, qualname string, ordinal int, line_start int, seq_added int, seq_removed int")
    asked = []

    def ranked_at(n, queries):
        asked.append((n, sorted(r["query_id"] for r in queries.collect())))
        return ranked.where(F.col("rank") <= n).join(queries, "query_id", "left_semi")

    out = lineage.widened(ranked_at, ranked.select("query_id").distinct(), rows, 2, 2, 1000, steady=True).collect()
    assert asked == [(2, [1, 2, 3]), (4, [3])]
    assert sorted((r["query_id"], r["rank"], r["lineage_id"]) for r in out) == [(1, 1, 10), (1, 2, 11), (2, 1, 10), (3, 1, 1), (3, 2, 10)]


def test_redundancy_takes_one_short_list(spark, monkeypatch):
    asked, search = [], sparse.search
    monkeypatch.setattr(sparse, "search", lambda *a: asked.append(a[4]) or search(*a))
    versions.lineage_redundancy(spark, "/root/testdata/sf0.001")
    assert asked == [10]


def test_tail_makes_its_lists_once(spark):
    plan = retrieval.rrf_tail(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_dense_task_hands_on_k_results(spark, monkeypatch):
    """Four blocks of vectors in one task give k rows a query, the right ones; so do those handed on early."""
    v = spark.createDataFrame([(i, [float(i % 5 + 1), float(i % 3)]) for i in range(40)], "id long, v array<double>").coalesce(1)
    made, top_k = [], dense.top_k
    monkeypatch.setattr(dense, "top_k", lambda s, k: made.append(s.count()) or top_k(s, k))
    unit = lambda i: np.array([i % 5 + 1, i % 3]) / np.hypot(i % 5 + 1, i % 3)
    want = sorted((q, r + 1, i) for q in range(40) for r, (_, i) in enumerate(sorted((-round(float(unit(q) @ unit(i)), 6), i) for i in range(40))[:3]))
    for kept in (4_000_000, 1):
        monkeypatch.setattr(dense, "KEPT", kept)
        got = dense.search(v, v, 3, 12)
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect()) == want
        assert made[-1] == 120 if kept > 1 else 120 < made[-1] <= 40 * 3 * 4


def test_hits_shuffle_no_postings(spark, monkeypatch):
    """Of every list that search_hits makes, only results are exchanged."""
    plans, search = [], sparse.search

    def seen(*a):
        out = search(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(sparse, "search", seen)
    versions.search_hits(spark, "/root/testdata/sf0.001")
    assert plans and all(p.count("Exchange hashpartitioning") == 1 for p in plans)


def test_written_leaves_no_shuffle(spark):
    """What a written table shuffled is gone once it is there, without waiting for the garbage of the driver."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    setting, before = spark.conf.get(session._SETTING, None), files()
    df = spark.range(50_000).selectExpr("id % 20000 as k", "id").repartition(3, "k").groupBy("k").count()
    out = session.written(df, "test")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(session._SETTING, None) == setting
    assert out.count() == df.count() == 20_000


def test_lists_keep_no_texts(spark, monkeypatch):
    """Of the texts searched only counts and ids are written, and the rows of lineages are made once."""
    made, keep = [], versions.written
    monkeypatch.setattr(versions, "written", lambda df, name: made.append((name, df.columns)) or keep(df, name))
    versions.search_hits(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in made].count("rows") == 1 and not [n for n, c in made if "text" in c and n != "asks"]


def test_store_fetches_new_texts_only(spark, tmp_path):
    """Records come without text; a later version asks only for texts that the store lacks, and merges only the states
    of rows in files that changed."""
    kind = "file_path string, qualname string, ordinal int, kind string, language string, line_start int, line_end int, snippet_id string"
    made = lambda ids: spark.createDataFrame([(f, "f", 0, "function", "python", 1, 2, i) for f, i in ids.items()], kind)
    hashes = lambda ids: spark.createDataFrame(list(ids.items()), "file_path string, file_hash string")
    texts = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "snippet_id string, text string")
    a, b, c = (x * 16 for x in "abc")
    ix = store.VersionedIndex(spark, str(tmp_path / "s"))
    first, second = {"x.py": a, "y.py": b, "z.py": "d" * 16}, {"x.py": a, "y.py": c, "z.py": "e" * 16}
    ix.index_snippets(hashes(first), lambda p: made(first).join(p, "file_path", "left_semi"), "v1", texts=texts(a, b))
    stats = ix.index_snippets(hashes(second), lambda p: made(second).join(p, "file_path", "left_semi"), "v2", texts=texts(c))
    assert (stats.files_changed, stats.texts_embedded, stats.counts["modified"], stats.counts["unchanged"]) == (2, 2, 2, 1)
    want = {a: f"text {a}", b: f"text {b}", c: f"text {c}", "d" * 16: None, "e" * 16: None}
    assert {r["snippet_id"]: r["text"] for r in ix.table("texts").collect()} == want
    only = ix.table("rows", spark.createDataFrame([("y.py",)], "file_path string")).collect()
    assert sorted((r["snippet_id"], r["seq_removed"]) for r in only) == [(b, 2), (c, None)]
