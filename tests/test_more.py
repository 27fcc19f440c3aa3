"""Store upkeep and texts, re-indexing, point queries, experiment metrics, caches, and search against brute force."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein import session
from skein.functions import javascript_extract
from skein.functions.embed import cached, hashed_bow, model_embed
from skein.functions.text import count_terms
from skein.operators import callgraph, dense, diff, history, lineage, metrics, ranking, sparse
from skein.plans import reindex
from skein.plans.answer import answer
from skein.plans.router import controls
from skein.plans.store import VersionedIndex
from skein.sources import code_files, datasets

from .test_store import V1, V2, V3, listing


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    ix = VersionedIndex(spark, str(tmp_path_factory.mktemp("store2")))
    ix.stats = [ix.index_version(listing(spark, v), n) for n, v in (("v1", V1), ("v2", V2), ("v3", V3))]
    return ix


def test_manifest_is_the_commit(spark, index, tmp_path):
    copy = index.copy_to(str(tmp_path / "copy"))
    step = copy.manifest["step"]
    (tmp_path / "copy" / f"manifest-{step + 1}.json").write_text('{"step": ')  # a writer that stopped half way
    again = VersionedIndex(spark, copy.path)
    assert again.manifest["step"] == step and again.valid_rows().count() == index.valid_rows().count()
    again.index_version(listing(spark, V2), "v4")
    assert VersionedIndex(spark, copy.path).seq() == 4
    assert all(s.total_seconds > 0 and set(s.seconds) == {"scan", "parse", "diff", "embed", "write"} for s in index.stats)


def test_a_failed_run_leaves_no_trace(spark, index, tmp_path):
    def broken(df, i, t):
        raise ValueError("no model")

    copy = index.copy_to(str(tmp_path / "copy"))
    copy.embed = broken
    with pytest.raises(ValueError):
        copy.index_version(listing(spark, V1 | {"new.py": "def brand_new(q):\n    return q\n"}), "v4")
    again = VersionedIndex(spark, copy.path)
    assert again.seq() == 3 and not [p for p in (tmp_path / "copy").iterdir() if p.name.startswith("tmp-")]


def test_compact_and_vacuum_free_bytes(spark, index, tmp_path):
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "copy").rglob("*.parquet"))
    copy = index.copy_to(str(tmp_path / "copy"))
    rows = sorted(map(tuple, copy.table("rows").collect()))
    before = size()
    copy.compact()
    assert size() < before and sorted(map(tuple, copy.table("rows").collect())) == rows and len(copy.manifest["tables"]["rows"]) == 1
    before = size()
    copy.vacuum()
    assert size() < before and len(list((tmp_path / "copy").glob("manifest-*.json"))) == 1


def test_an_older_store_is_migrated(spark, index, tmp_path):
    copy = index.copy_to(str(tmp_path / "copy"))
    want = {r["row_id"]: r["lineage_id"] for r in copy.table("rows").collect()}
    copy._publish({"rows": copy.table("rows").drop("lineage_id")}, layout=1)
    assert {r["row_id"]: r["lineage_id"] for r in VersionedIndex(spark, copy.path).table("rows").collect()} == want


def test_result_lines(index):
    r = {"file_path": "a.py", "line_start": 1, "line_end": 2, "qualname": "f", "version_added": "v3", "valid_through": "v5"}
    assert index.describe_result(r) == "a.py:1-2  f  [v3..v5]" and index.describe_result({**r, "valid_through": "v3"}) == "a.py:1-2  f  [v3]"
    g = {**r, "n_versions": 2, "versions": ["v1", "v3"], "matched_differs": True, "matched_version": "v1"}
    assert index.describe_result(g) == "a.py:1-2  f  [2 versions: v1, v3]  showing v3..v5, matched on the wording of v1"
    hit = index.search("parse config", k=1, as_of="v2").first()
    assert hit["valid_through"] == "v2" and index.search("helper", k=1).first()["valid_through"] == "v3"


def test_history_text(index):
    a = answer("history of parse_config", None, None, history=index)
    assert "v1       added" in a.text and "v2       modified" in a.text and "v3       reverted" in a.text
    assert "      +        return data or {}" in a.text and "      -        return json.load(f)" in a.text
    assert answer("history of nothing", None, None, history=index).text.endswith("in the versioned index.")
    moved = index.history("compute_total").collect()
    assert [r["lineage_place"]["file_path"] for r in moved] == ["utils.py"] * len(moved) and [r["valid_through"] for r in moved] == ["v1", "v3"]
    assert answer("find a parser", None, None, semantic=lambda q: index.search(q, k=3)).text == "3 semantic results"


def test_search_many_widens(spark, index):
    asks = spark.createDataFrame([(1, "parse config json load"), (2, "save record"), (3, "")], "query_id int, text string")
    n = index.table("rows").select("lineage_id").distinct().count()
    got = index.search_many(asks.where("query_id < 3"), k=n, as_of="all", candidates=1, use_bm25=False).collect()
    assert Counter(r["query_id"] for r in got) == {1: n, 2: n}
    one = [(r["rank"], r["lineage_id"]) for r in index.search("save record", k=4, as_of="all").collect()]
    assert one == sorted((r["rank"], r["lineage_id"]) for r in index.search_many(asks, k=4, as_of="all").where("query_id = 2").collect())


CODE = "import os\n\n@wrap\ndef first(a):\n    return a + 1\n\ndef second(b):\n    return b\n"


@pytest.mark.parametrize("kind", reindex.KINDS)
def test_edits_keep_code_valid(kind):
    import ast

    new, done, moved = reindex.edit(CODE, kind, 7)
    ast.parse(new)
    assert done == kind and new != CODE and (moved is not None) == (kind == "move_function")
    assert reindex.edit("x = 'a'\n", "delete_function", 3) == ("x = 'a'\nchanged_3 = 3\n", "modify", None)


def test_reindex_comparison(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"def f{i}(x):\n    '''number {i} of some functions of this repository'''\n    return x + {i}") for i in range(30)] + [(90, "def broken("), (91, None), (92, "x=1")], "doc_id int, text string")
    files = datasets.repository(docs, "doc_id", "text", 28)
    assert files.count() == 28 and {r["file_path"] for r in files.collect()} >= {"pkg_000/mod_00000.py", "pkg_001/mod_00027.py"}
    out = reindex.compare(spark, files, 6, str(tmp_path), queries=spark.createDataFrame([(1, "number 7")], "query_id int, text string"))
    assert out["equivalent"] and out["incremental"]["files_changed"] == 7 and out["full"]["files_parsed"] == 29 and out["incremental"]["texts_embedded"] <= 6
    datasets.write_report(spark, out, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["equivalent"] is True
    datasets.write_rows(files.select("file_path"), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 28


def test_timeline_by_number(spark, tmp_path):
    for v, files in (("base", {"a.py": "1", "b.py": "1"}), ("o/v10", {"a.py": "10"}), ("o/v2", {"a.py": "2", "c.py": "2"}), ("o/notes", {"a.py": "x"})):
        for name, text in files.items():
            p = tmp_path / v / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    got = [(v, {r["file_path"]: bytes(r["content"]).decode() for r in f.collect()}) for v, f in code_files.timeline(spark, str(tmp_path / "base"), str(tmp_path / "o"))]
    assert got == [("v1", {"a.py": "1", "b.py": "1"}), ("v2", {"a.py": "2", "b.py": "1", "c.py": "2"}), ("v10", {"a.py": "10", "b.py": "1", "c.py": "2"})]


def test_state_at_folds_from_the_checkpoint(spark, tmp_path):
    rows = [("a", s, s != 9, f"v{s // 2}", s * 1.0) for s in (1, 2, 3, 6, 9)] + [("b", 5, True, "x", None), ("c", None, True, "old", 0.0)]
    ev = spark.createDataFrame(rows, "k string, seq int, live boolean, name string, n double")
    history.save(history.build_store(ev, ["k"], ["name", "n"]), str(tmp_path / "h"))
    store = history.load(spark, str(tmp_path / "h"))
    at = lambda s: {r["k"]: (r["name"], r["n"]) for r in history.state_at(store, ["k"], ["name", "n"], s).collect()}
    assert at(0) == {"c": ("old", 0.0)} and at(2) == {"a": ("v1", 2.0), "c": ("old", 0.0)} and at(5) == {"a": ("v1", 3.0), "b": ("x", None), "c": ("old", 0.0)}
    assert at(8)["a"] == ("v3", 6.0) and at(9) == {"b": ("x", None), "c": ("old", 0.0)}
    empty = history.build_store(ev.where("false"), ["k"], ["name", "n"])
    assert history.state_at(empty, ["k"], ["name", "n"], 3).count() == 0


def test_experiment_metrics(spark):
    raw = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (2, "c", 3)], "query_id int, file_path string, lineage_id int")
    targets = spark.createDataFrame([(1, "b"), (1, "z"), (2, "d"), (3, "a")], "query_id int, file_path string")
    r = metrics.hit_rate(metrics.hits(raw, targets)).first()
    assert (r["n_queries"], r["n_hits"]) == (3, 1) and math.isclose(r["hit_rate"], 0.333333)
    assert [tuple(x) for x in metrics.lost_lineages(raw, raw.where("lineage_id <> 2")).collect()] == [(1, 1)]
    assert metrics.lost_lineages(raw, raw).count() == 0 and metrics.hit_rate(metrics.hits(raw, targets.where("false"))).first()["hit_rate"] is None
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "lineage_id int")
    assert {(x["n_versions"], x["n_lineages"]) for x in metrics.versions_histogram(rows).collect()} == {(1, 2), (2, 1)}


def test_embedding_cache(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def load():
        def run(texts):
            with open(seen, "a") as f:
                f.write("x" * len(texts))
            return [[float(len(t))] for t in texts]

        return run

    embed = cached(model_embed(load, "q: "), str(tmp_path / "cache"), "model/query")
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "")], "id int, text string")
    want = {1: [5.0], 2: [5.0], 3: [3.0], 4: [3.0]}
    assert {r["id"]: r["v"] for r in embed(df, "id", "text").collect()} == want and len(open(seen).read()) == 2
    assert {r["id"]: r["v"] for r in embed(df, "id", "text").collect()} == want and len(open(seen).read()) == 2
    other = cached(hashed_bow, str(tmp_path / "cache"), "bow")
    assert {len(r["v"]) for r in other(df, "id", "text").collect()} == {128}


def test_graph_and_vectors_on_disk(spark, tmp_path):
    defs = spark.createDataFrame([(1, "f", "f", "function", "a", 1, 2), (2, "g", "g", "function", "a", 3, 4), (3, "g", "C.g", "method", "b", 1, 2)], "id int, name string, qualname string, kind string, file_path string, line_start int, line_end int")
    calls = spark.createDataFrame([(1, "g", 1, 0), (1, "len", 2, 1), (1, "g", 2, 2)], "caller_id int, callee_name string, line int, call_order int")
    assert callgraph.save(defs, calls, str(tmp_path)) == {"files": 2, "snippets": 3, "calls": 3}
    rows = callgraph.callees(*callgraph.load(spark, str(tmp_path)), "f").collect()
    assert [(r["callee_name"], r["line"], r["defined_at"]) for r in rows] == [("g", 1, "a:3"), ("g", 1, "b:1"), ("len", 2, None)]
    assert "calls g at line 1 -> a:3, b:1\n      calls len at line 2 (not defined in the indexed code)" in answer("what does f call", defs, calls).text
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>")
    dense.save(v, str(tmp_path / "v"))
    assert dense.load(spark, str(tmp_path / "v")).count() == 2 and dense.removed(v, v.where("id = 2").select("id")) == 1


def test_search_equals_brute_force(spark, monkeypatch):
    """Small blocks, hot terms spread over several keys, ties, repeated and empty texts."""
    monkeypatch.setattr(sparse, "HELD", 7)
    monkeypatch.setattr(sparse, "ASKED", 3)
    monkeypatch.setattr(sparse, "SPREAD", 2)
    monkeypatch.setattr(sparse, "STEP", 50)
    texts = {i: " ".join(["common"] * (i % 3 + 1) + [f"w{i % 5}", f"x{i % 11}"] + ["tie"] * (i % 2)) for i in range(60)} | {98: "", 99: None}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    got = {}
    for r in sparse.search(sparse.build(df, "id", "text"), df, "id", "text", 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    counts = {i: count_terms(t) for i, t in texts.items()}
    n, avg, dfs = len(texts), sum(sum(c.values()) for c in counts.values()) / len(texts), Counter(t for c in counts.values() for t in c)
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in dfs.items()}
    idf = {t: x if x >= 0 else sparse.EPSILON * sum(raw.values()) / len(raw) for t, x in raw.items()}
    for q, asked in counts.items():
        scores = {i: round(sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for t, m in asked.items() if t in c), 6) for i, c in counts.items()}
        best = sorted(((-s, i) for i, s in scores.items() if s > 0))[:4]
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best], q


def test_row_numbers_of_large_groups(spark):
    df = spark.range(200).selectExpr("id % 3 k", "id v")
    a, b = (sorted(map(tuple, ranking.spread_row_number(df, ["k"], ["v"], largest=n).collect())) for n in (0, 1000))
    assert a == b and len(a) == 200


def test_shared_folder(spark, monkeypatch):
    t = session.written(spark.range(5).withColumn("a", F.array("id")), "t")
    assert t.count() == 5
    session.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()

    class Far:  # a cluster without a checkpoint folder
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError):
        session.shared_dir(Far)


def test_calls_in_template_literals():
    code = "function f(a) {\n  return `x ${g(a, `in ${h({b: 1})} y`)} \\` $ {k()}\n${m(a / 2)}` + n()\n}\np(`}`)\n"
    made = {d["qualname"]: [(c["callee"], c["line"]) for c in d["calls"]] for d in javascript_extract.extract(code)}
    assert made == {"f": [("g", 2), ("h", 2), ("m", 3), ("n", 3)], "<module>": [("p", 5)]}
    assert [d["qualname"] for d in javascript_extract.extract("const q = () => `${r()")] == ["q"]


def test_records_come_in_order_of_key(spark):
    cols = "file_path string, qualname string, ordinal int, snippet_id string"
    old = spark.createDataFrame([("b", "y", 0, "1"), ("b", "x", 1, "2"), ("a", "z", 0, "3"), ("b", "x", 0, "4")], cols)
    gone = diff.records(diff.diff_snippets(old, old.where("false")), "deleted").collect()
    assert [(r["old_file_path"], r["old_qualname"], r["old_ordinal"]) for r in gone] == [("a", "z", 0), ("b", "x", 0), ("b", "x", 1), ("b", "y", 0)]


def test_controls_and_span():
    assert controls([("who calls f", "callers"), ("sort a list", None), ("history of the war", "history")]) == {"n_controls": 3, "n_controls_right": 2}
    assert lineage.span("v1", "v1") == "v1" and lineage.span("v1", "v4") == "v1..v4"
