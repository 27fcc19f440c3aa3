"""Search, fusion, metrics, call graph, differences and lineages: known answers and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from skein.catalog import structure, versions
from skein.functions import javascript_extract, python_extract
from skein.functions.embed import hashed_bow
from skein.operators import callgraph, dense, diff, extract, fusion, lineage, metrics, ranking, sparse
from skein.plans.answer import answer
from skein.plans.pipeline import Retrieval
from skein.plans.router import classify, safety
from skein.sources import code_files

CORPUS = [
    (0, "def normalize_text(s): return s.strip().lower()"),
    (1, "def validate_input(x):\n    if not isinstance(x, str): raise TypeError('check the input type')"),
    (2, "def timed(fn):\n    start = time.time(); fn(); print(time.time() - start)"),
    (3, "def total(array): return sum(array)  # sum of an array"),
    (4, "async function fetchJson(url) { return (await fetch(url)).json(); } // get json from an url"),
]


def ranked(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_fusion_known_answers(spark):
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id int, id string, rank int") for ids in ("abc", "bda")]
    out = {r["id"]: (r["rank"], r["score"]) for r in fusion.fuse(lists).collect()}
    assert [k for k, _ in sorted(out.items(), key=lambda x: x[1])] == list("badc")
    assert math.isclose(out["b"][1], 1 / 62 + 1 / 61) and math.isclose(out["a"][1], 1 / 61 + 1 / 63) and math.isclose(out["c"][1], 1 / 63)
    w = fusion.fuse(lists, [1.0, 0.3])
    assert ranked(w)[:2] == ["a", "b"] and ranked(fusion.fuse(lists, top_k=2)) == ["b", "a"] and len(ranked(fusion.fuse(lists, top_k=0))) == 4
    none = spark.createDataFrame([], "query_id int, id string, rank int")
    assert fusion.fuse([none, none]).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse([])


def test_bm25_known_answers(spark):
    index = sparse.build(spark.createDataFrame(CORPUS, "id int, text string"), "id", "text")
    q = spark.createDataFrame([(1, "validate input type check"), (2, "fetch json from url"), (3, "sum of array"), (4, "zzzz qqqq"), (5, None), (6, "")], "q int, text string")
    hits = sparse.search(index, q, "q", "text", 3).collect()
    assert {r["query_id"]: r["id"] for r in hits if r["rank"] == 1} == {1: 1, 2: 4, 3: 3}
    assert all(r["score"] > 0 for r in hits)


def test_bm25_empty_and_save(spark, tmp_path):
    empty = sparse.build(spark.createDataFrame([], "id int, text string"), "id", "text")
    q = spark.createDataFrame([(1, "x")], "q int, text string")
    assert sparse.search(empty, q, "q", "text").count() == 0
    index = sparse.build(spark.createDataFrame(CORPUS + [(9, None), (10, "")], "id int, text string"), "id", "text")
    index.save(str(tmp_path / "ix"))
    again = sparse.Bm25Index.load(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "sum array url")], "q int, text string")
    assert sparse.search(again, q, "q", "text").collect() == sparse.search(index, q, "q", "text").collect()


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])], "id long, v array<float>")
    q = v.where("id = 1")
    assert ranked(dense.search(v, q, 10)) == [1, 6, 2, 3]  # ties by id; other lengths and nulls take no part
    assert ranked(dense.search(v, q, 10, block=1)) == [1, 6, 2, 3]
    assert dense.search(v.where("id > 99"), q).count() == 0
    assert {r["id"] for r in dense.remove(v, q).collect()} == {2, 3, 4, 5, 6}
    assert dense.add(v, v).count() == 6 and dense.allowed(v, q).count() == 1


def test_pipeline_modes(spark):
    r = Retrieval(spark.createDataFrame(CORPUS, "id int, text string"), scorer=lambda q, t: F.length(t) * 0.0 + F.instr(t, "lower"))
    q = spark.createDataFrame([(7, "normalize text")], "query_id int, text string")
    assert ranked(r.search(q, "bm25"))[0] == 0 and ranked(r.search(q, "dense"))[0] == 0
    rrf = r.search(q, "rrf", top_k=5)
    assert ranked(rrf)[0] == 0 and rrf.count() == 5
    assert ranked(r.search(q, "rerank", top_k=3, rerank_m=5))[0] == 0
    with pytest.raises(ValueError):
        r.search(q, "other")


def test_metrics(spark):
    judged = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1)], "query_id int, rank int, rel int")
    n = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 0)], "query_id int, n_rel int")
    m = {(r["metric"], r["k"]): r["value"] for r in metrics.ir_metrics(judged, n, (1, 3)).collect()}
    assert m["mrr", 3] == 0.5 and m["hit_rate", 1] == pytest.approx(1 / 3, abs=1e-6) and m["recall", 3] == 0.5
    assert m["ndcg", 3] == pytest.approx((1 / math.log2(3) + 1 / (1 + 1 / math.log2(3))) / 3, abs=1e-6)
    red = metrics.redundancy(spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "query_id int, lineage_id int")).first()
    assert red["mean_wasted"] == 0.5 and red["wasted_share"] == 0.25


PY = '''from text import collapse as squash, run
import helpers.tools as kit

def normalize(s):
    """Doc."""
    return squash(s.strip()).lower()

@register(name())
class Renderer(Base):
    size = default_size()

    def draw(self, out):
        self.clear()
        for x in self.items:
            out.append(fmt(x))
        def inner():
            return self.join(x)
        return inner

def main():
    run(normalize(read()))
    kit.close()

main()
'''
JS = '''const { fmt: format, log } = require("./io");
import { tidy as clean } from "./tidy";
class Renderer {
  constructor(x) { this.x = x; }
  draw(items) {
    this.clear();
    items.forEach((i) => { this.push(format(i)); });
    return items.join(`${sep}`);
  }
}
function main(a) {
  const s = /[(]x\\//.test(a) ? clean(a) : a / 2 / log(a);
  return new Renderer(s).draw(s);
}
const go = async (x) => main(x);
exports.stop = function () { log("stop()"); };
Store.prototype.save = function (r) { this.rows.push(r); };
main(1);
'''


def test_python_extract():
    d = {x["qualname"]: x for x in python_extract.extract(PY, True)}
    calls = {k: [c["callee"] for c in v["calls"]] for k, v in d.items()}
    assert {k: v["kind"] for k, v in d.items()} == {"normalize": "function", "Renderer": "class", "Renderer.draw": "method", "inner": "function", "main": "function", "<module>": "module"}
    assert calls["normalize"] == ["collapse", "strip", "lower"] and calls["Renderer.draw"] == ["clear", "append", "fmt"] and calls["inner"] == ["join"]
    assert calls["main"] == ["run", "normalize", "read", "close"] and calls["<module>"] == ["register", "name", "default_size", "main"]
    assert python_extract.extract("def f(:") == [] and python_extract.extract("") == []
    a, b = (python_extract.extract(s)[0]["snippet_id"] for s in ("def f(a):\n    return g(a, 1)\n", "def f( a ):\n\n    return g(a,\n             1)\n"))
    assert a == b
    c, e = (python_extract.extract("def f(a):\n    # note\n    return 1\n", False, s)[0]["snippet_id"] for s in (False, True))
    assert c != e == python_extract.extract("def f(a):\n    return 1\n")[0]["snippet_id"]


def test_javascript_extract():
    d = {x["qualname"]: x for x in javascript_extract.extract(JS, True)}
    calls = {k: [c["callee"] for c in v["calls"]] for k, v in d.items()}
    assert {"Renderer", "Renderer.constructor", "Renderer.draw", "main", "go", "stop", "Store.save", "<module>"} == set(d)
    assert calls["Renderer.draw"] == ["clear", "forEach", "push", "fmt", "join"]
    assert calls["main"] == ["test", "tidy", "log", "Renderer", "draw"] and calls["go"] == ["main"] and calls["stop"] == ["log"] and calls["Store.save"] == ["push"]
    assert calls["<module>"] == ["main"]
    assert javascript_extract.extract("") == []


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("src/app.py", PY), ("src/app.js", JS), ("x.txt", "no"), ("e.py", None)], "file_path string, content string")
    defs, calls = extract.call_graph(extract.facts(files))
    return defs.cache(), calls.cache()


def names(df):
    return {(r["file_path"], r["qualname"]) for r in df.collect()}


def test_call_graph(graph):
    defs, calls = graph
    assert names(callgraph.callers(defs, calls, "normalize")) == {("src/app.py", "main")}
    assert names(callgraph.definition(defs, "Renderer.draw")) == {("src/app.py", "Renderer.draw"), ("src/app.js", "Renderer.draw")}
    assert callgraph.is_defined(defs, "main") and not callgraph.is_defined(defs, "nope")
    assert [r["callee_name"] for r in callgraph.callees(defs, calls, "normalize").collect()] == ["collapse", "strip", "lower"]
    assert names(callgraph.calls_before(defs, calls, "clear", "join")) == {("src/app.js", "Renderer.draw")}
    assert callgraph.calls_before(defs, calls, "join", "clear").count() == 0
    t = {(r["qualname"], r["depth"]) for r in callgraph.transitive_callers(defs, calls, "collapse").collect()}
    assert ("normalize", 1) in t and ("main", 2) in t and ("<module>", 3) in t


def test_recursion_ends(spark):
    defs = spark.createDataFrame([(1, "f", "f", "function", "a", 1, 2), (2, "g", "g", "function", "a", 3, 4)], "id int, name string, qualname string, kind string, file_path string, line_start int, line_end int")
    calls = spark.createDataFrame([(1, "f", 1, 0), (1, "g", 2, 1), (2, "f", 3, 0)], "caller_id int, callee_name string, line int, call_order int")
    assert {(r["qualname"], r["depth"]) for r in callgraph.transitive_callers(defs, calls, "f").collect()} == {("f", 1), ("g", 1)}


def test_transitive_callers_whole_graph(spark, tmp_path):
    """A chain of 12 downward calls to n90 with a cycle, against a walk by hand; a filter or a small depth loses most of it."""
    edges = {(91, 90), (90, 95), (95, 91)} | {(k + 1, k) for k in range(95, 106)} | {(3, 90)}
    spark.createDataFrame([(s, p) for s, p in edges], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want, level = {}, {90}
    for depth in range(1, 11):
        level = {s for s, p in edges if p in level and s not in want}
        want |= dict.fromkeys(level, depth)
    got = {r["qualname"]: r["depth"] for r in structure.transitive_callers(spark, str(tmp_path)).collect()}
    assert got == {f"n{k}": v for k, v in want.items()} and want[90] == 3 and max(want.values()) == 10


def test_answers(graph):
    defs, calls = graph
    a = answer("Which functions call normalize?", defs, calls)
    assert a.kind == "callers" and "main  (lines" in a.text and "calls at line" in a.text
    assert "none found. No function" in answer("who calls nothing_here", defs, calls).text
    assert "not defined in the indexed code" in answer("what does normalize call", defs, calls).text
    assert answer("sort a list quickly", defs, calls).route == "semantic"
    assert "no versioned index" in answer("history of main", defs, calls).text
    with pytest.raises(ValueError):
        answer("who calls main", None, None)


ROUTES = {
    "Which functions call normalize?": "callers", "who calls readInput": "callers", "Where is `checkType()` called?": "callers", "what does main call": "callees", "callees of Renderer.draw": "callees",
    "where is normalize defined": "definition", "Which files call x before y?": "before", "everything that transitively calls log": "transitive", "all versions of pad": "history",
    "how has normalize changed over time": "history", "which function calls the": None, "which functions call x before x": None, "history of the roman empire problem": None, "": None, None: None,
    "Who calls x\nplease": None, "write a function that sorts": None,
}


@pytest.mark.parametrize("q", list(ROUTES))
def test_router(q):
    got = classify(q)
    assert (got.kind if got else None) == ROUTES[q]


def test_router_safety(spark):
    r = safety(spark.createDataFrame([(q,) for q in ROUTES] + [("who calls f " + "in the code " * 20,)], "text string"), "text").first()
    assert r["n_routed"] == sum(v is not None for v in ROUTES.values()) and r["n_longer"] == 1


@pytest.mark.parametrize("words, median", [([3, 1, 2], 2), ([4, 1, 1, 9], 4), ([0, 5], 5), ([7], 7), ([], None)])
def test_router_safety_upper_median(spark, words, median):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in words], "text string")
    assert safety(df, "text").first()["median_words"] == median


def test_diff(spark):
    cols = "file_path string, qualname string, ordinal int, snippet_id string"
    old = spark.createDataFrame([("a", "same", 0, "1"), ("a", "edit", 0, "2"), ("a", "gone", 0, "3"), ("a", "mv", 0, "4"), ("a", "ren", 0, "5"), ("a", "d1", 0, "7"), ("a", "d2", 0, "7")], cols)
    new = spark.createDataFrame([("a", "same", 0, "1"), ("a", "edit", 0, "2b"), ("b", "mv", 0, "4"), ("a", "renamed", 0, "5"), ("a", "fresh", 0, "6"), ("b", "d", 0, "7")], cols)
    c = diff.counts(diff.diff_snippets(old, new)).first()
    assert (c["added"], c["deleted"], c["unchanged"], c["modified"], c["moved"]) == (1, 2, 1, 1, 3)
    none = old.where("false")
    assert diff.counts(diff.diff_snippets(none, new)).first()["added"] == 6 and diff.diff_snippets(none, none).count() == 0


def test_diff_of_all_versions(spark, tmp_path):
    """Versions 1, 4 and 5 of one repository and 2 of another: each but the first against the nearest earlier one."""
    rows = [("r", 1, "a", "f", "1", 0), ("r", 1, "a", "g", "2", 0), ("r", 4, "b", "f", "1", 0), ("r", 4, "a", "g", "0", 0), ("r", 4, "a", "g", "3", 1), ("r", 5, "b", "f", "1", 0), ("r", 5, "b", "h", "4", 0), ("q", 2, "a", "f", "1", 0)]
    df = spark.createDataFrame(rows, "repo string, seq int, file_path string, qualname string, snippet_id string, scanned_at int").withColumns({"ordinal": F.lit(0), "kind": F.lit("function")})
    df.write.parquet(str(tmp_path / "snippet_scans.parquet"))
    got = {(r["repo"], r["seq"], r["change_class"], r["old_file_path"], r["new_file_path"]) for r in versions.diff_classes(spark, str(tmp_path)).collect()}
    assert got == {("r", 4, "moved", "a", "b"), ("r", 4, "modified", "a", "a"), ("r", 5, "unchanged", "b", "b"), ("r", 5, "deleted", "a", None), ("r", 5, "added", None, "b")}


def test_spread_row_number(spark):
    df = spark.range(500).select((F.col("id") % 7 % 2).alias("k"), F.hash("id").alias("o"))
    a = ranking.spread_row_number(df, ["k"], ["o"])
    want, got = {}, {}
    for r in df.collect():
        want.setdefault(r["k"], []).append(r["o"])
    for r in a.collect():
        got[r["k"], r["rn"]] = r["o"]
    assert got == {(k, i): o for k, v in want.items() for i, o in enumerate(sorted(v), 1)}


def test_lineage_pure(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "f", "q", 0, "function", 1, 3), (2, 1, "b", "f", "q", 0, "function", 3, 5), (3, 1, "a", "f", "q", 0, "function", 5, None), (4, 4, "z", "g", "p", 0, "function", 1, 2), (5, 4, "z", "h", "p", 0, "function", 2, None)],
        "row_id long, lineage_id long, snippet_id string, file_path string, qualname string, ordinal int, kind string, seq_added int, seq_removed int",
    )
    assert [r["change"] for r in lineage.history(rows).orderBy("row_id").collect()] == ["added", "modified", "reverted", "added", "moved"]
    assert lineage.as_of(rows, 3).count() == 2 and lineage.between(rows, 1, 3).count() == 4
    assert {r["row_id"]: r["new_lineage_id"] for r in lineage.backfill(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert lineage.groups(rows).where("lineage_id = 1").first()["versions"] == [1, 3, 5]
    assert lineage.named(rows, "q").count() == 3 and lineage.named(rows, "nope").count() == 0
    with pytest.raises(ValueError):
        lineage.between(rows, 3, 1)


def test_files(spark, tmp_path):
    for p, text in {"a.py": "x = 1", "sub/b.JS": "y", "node_modules/c.js": "z", "d.txt": "no"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    got = code_files.scan(spark, str(tmp_path))
    assert {r["file_path"] for r in got.collect()} == {"a.py", "sub/b.JS"}
    layers = spark.createDataFrame([(1, "a", "1"), (2, "a", "2"), (1, "b", "x"), (3, "b", None)], "seq int, file_path string, content string")
    assert {r["file_path"]: bytes(r["content"]) for r in code_files.overlay(layers, 3).collect()} == {"a": b"2"}
    d = code_files.changed_files(code_files.overlay(layers, 1), code_files.overlay(layers, 3))
    assert {(r["file_path"], r["change"]) for r in d.collect()} == {("a", "edited"), ("b", "removed")}


def test_hashed_bow(spark):
    df = spark.createDataFrame([(1, "ab ab cd"), (2, None), (3, "1 2 3")], "id int, text string")
    v = {r["id"]: r["v"] for r in hashed_bow(df, "id", "text").collect()}
    assert sum(v[1]) == 3 and len(v[1]) == 128 and not any(v[2]) and not any(v[3])
