"""The text operators against brute force, invariants and edge cases."""

import ast
import math
import random
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions.text import count_terms
from skein.llm import abuse, javascript_source, mixing, packing, parsing, python_source, splitting, terms, tokens
from skein.llm.gll import Grammar

# ---- splitting


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\r\t(){};,é漢", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in got)
    assert [b - a for (_, b), (a, _) in zip(got, got[1:])] == [overlap] * (len(got) - 1)
    assert "".join(text[a if i == 0 else a + overlap : b] for i, (a, b) in enumerate(got)) == text
    if len(text) > limit:
        assert len(got) > 1


def test_pieces_prefer_topic_changes():
    a = "".join(f"alpha beta gamma {i}\n" for i in range(10))
    b = "".join(f"delta omega sigma {i}\n" for i in range(10))
    (_, cut), *_ = splitting.pieces(a + b, len(a) + 60, 0)
    assert cut == len(a)
    assert splitting.pieces("", 10, 2) == [] and splitting.pieces("x" * 30, 10, 2)[0] == (0, 10)
    with pytest.raises(ValueError):
        splitting.pieces("x", 5, 5)


def test_split_texts(spark):
    long = "def f():\n" + "".join(f"    x{i} = call(y{i})\n" for i in range(300))
    t = spark.createDataFrame([("AA", 1, long, 9), ("bb", 2, "short", 9), ("cc", 3, None, 9), ("dd", 4, long, 9), ("ee", 5, "y" * 9000, 9)], "snippet_id string, vector_id long, text string, piece int")
    rows = [("aa", "PY", "r", "a.py", 10, 400, "2024-01-01"), ("aa", None, "r", "b.py", 10, 40, "2024-01-02"), ("bb", "python", "r", "b.py", 1, 2, "2024-01-01"), ("ee", None, "r", "e.mjs", 5, None, "2024-01-01"), ("zz", None, "r", "z.txt", 1, 1, "2024-01-01")]
    s = spark.createDataFrame(rows, "snippet_id string, language string, repo string, file_path string, line_start int, line_end int, exported_at string").withColumn("exported_at", F.to_timestamp("exported_at"))
    lim = spark.createDataFrame([("python", 1800, 120), ("JS", 1500, 100)], "language string, max_chars int, overlap_chars int")
    got = splitting.split_texts(t, s, lim)
    p = sorted(got.where("snippet_id = 'aa'").collect(), key=lambda r: r["piece"])
    assert "".join(r["piece_text"][120 if r["piece"] else 0 :] for r in p) == long
    assert p[0]["line_start"] == 10 and max(r["line_end"] for r in p) <= 40 and all(r["line_start"] <= r["line_end"] for r in p)
    assert {r["snippet_id"] for r in splitting.oversized(got).collect()} == {"aa", "ee"}
    assert splitting.split_texts(t.where("false"), s, lim).count() == 0


# ---- terms


def test_terms_equal_brute_force(spark):
    docs = {1: "parseHttp parse_http 12", 2: "parse the url url", 3: "", 4: None, 5: "only5"}
    got = {(r["k"], r["term"]): r for r in terms.term_scores(spark.createDataFrame(list(docs.items()), "k int, text string"), "k", "text").collect()}
    tf = {k: count_terms(t) for k, t in docs.items()}
    cf = sum(tf.values(), Counter())
    total = sum(cf.values())
    assert tf[1] == Counter({"parsehttp": 2, "parse": 2, "http": 2, "12": 1})
    assert set(got) == {(k, t) for k, c in tf.items() for t in c}
    for (k, t), r in got.items():
        p, c = (tf[k][t] + terms.MU * cf[t] / total) / (sum(tf[k].values()) + terms.MU), cf[t] / total
        df = sum(t in x for x in tf.values())
        assert r["df"] == df and r["score"] == pytest.approx(p * math.log(p / c) if df > 1 else 0.0, abs=2e-6)
    assert terms.term_scores(spark.createDataFrame([], "k int, text string"), "k", "text").count() == 0


def test_hot_terms_are_whole(spark):
    df = spark.range(400).select("id", F.concat(F.lit("common w"), (F.col("id") % 50).cast("string")).alias("text"), F.lit("x").alias("term"), F.lit(1).alias("df"))
    got = terms.term_scores(df, "id", "text")
    assert got.where("term = 'common'").count() == 400 and got.where("term = 'common' and df = 400").count() == 400


# ---- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.sampled_from("abc"), st.integers(0, 6)), max_size=60))
def test_pack_invariants(items):
    cap = 10
    got = packing.pack([s for s, _, _ in items], cap, [s for _, s, _ in items], [c for _, _, c in items], (("a", "b"),))
    whole, held, srcs = defaultdict(int), defaultdict(int), defaultdict(set)
    for i, part, b, size in got:
        whole[i] += size
        held[b] += size
        srcs[b].add(items[i][1])
        assert size == cap or part == items[i][0] // cap - (items[i][0] % cap == 0 and items[i][0] > 0)
    assert dict(whole) == {i: s for i, (s, _, _) in enumerate(items)}
    assert all(v <= cap for v in held.values()) and not any({"a", "b"} <= s for s in srcs.values())


def test_pack_keeps_copies_apart_and_fills():
    rng = random.Random(1)
    sizes = [rng.randint(1, 300) for _ in range(3000)]
    clusters = [f"c{i % 40}" if i < 200 else i for i in range(3000)]
    got = packing.pack(sizes, 512, clusters=clusters)
    pairs = Counter((b, clusters[i]) for i, _, b, _ in got)
    assert max(pairs.values()) == 1
    assert sum(sizes) / (512 * len({b for _, _, b, _ in got})) > 0.99
    third = packing.pack([10] * 900, 500, clusters=[0] * 300 + list(range(1, 601)))
    assert max(Counter(b for i, _, b, _ in third if i < 300).values()) == 1  # copies stay apart, however many
    dealt = packing.pack([10] * 900, 500, clusters=[0] * 300 + list(range(1, 601)), max_copies=25)
    assert len({b for _, _, b, _ in dealt}) <= 19 and max(Counter(b for i, _, b, _ in dealt if i < 300).values()) <= 25
    assert packing.pack([], 5) == [] and packing.pack([0, 0], 5, clusters=[1, 1]) == [(0, 0, 0, 0), (1, 0, 0, 0)]


def test_pack_documents(spark):
    text = "word " * 700
    rows = [(1, "A b", text), (1, "A b", text), (2, None, None), (3, "x", ""), (4, "x", "short")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("block", F.lit(1)).withColumn("part", F.lit(2))
    specs = spark.createDataFrame([("short", 512)], "container string, capacity_tokens int")
    got = packing.pack_documents(docs, specs).collect()
    n = len(tokens.encoder(tokens.FOLDER, tokens.VOCABULARY).encode_ordinary(text))
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 1) == 2 * n and {r["doc_id"] for r in got} == {1, 2, 3, 4}
    assert packing.pack_documents(docs.where("false"), specs).count() == 0
    assert packing.fill_report(packing.pack_documents(docs, specs), specs).first()["fullest"] == 512
    assert packing.pack_documents(docs, specs.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, spark.createDataFrame([("none", 0)], "container string, capacity_tokens int"))


def test_packing_does_not_depend_on_layout(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Code Files", "chat-exports", "readmes", None]), " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(rng.randrange(3, 60)))) for i in range(300)]
    rows += [(1000 + i, "readmes", "the very same text of a row") for i in range(60)] + [(7, "readmes", "again and again")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    specs = spark.createDataFrame([("short", 128), ("long", 700)], "container string, capacity_tokens int")
    got = [sorted(map(tuple, packing.pack_documents(x, specs, block=64).collect())) for x in (docs.repartition(1), docs.repartition(7, "text"), docs.orderBy("text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) >= 2 * len(rows)
    unique = docs.dropDuplicates(["doc_id"])
    found = [r.asDict() for r in packing.checks(unique, packing.pack_documents(unique, specs, block=64), specs).collect()]
    assert [sum(v for k, v in r.items() if k not in ("container", "n_docs")) for r in found] == [0, 0] and {r["n_docs"] for r in found} == {360}
    fill = {r["container"]: r["filled"] for r in packing.fill_report(packing.pack_documents(docs, specs, block=64, apart=()), specs).collect()}
    assert fill["short"] > 0.8  # 60 copies of a short text need as many containers


def test_cluster_keys(spark):
    pairs = [("A b,  C!", "a B c 12"), ("12", "12"), ("12", "13"), ("", ""), (None, None), ("é", "é")]
    df = spark.createDataFrame(pairs, "x string, y string").select((packing.cluster_key(F.col("x")) == packing.cluster_key(F.col("y"))).alias("same"))
    assert [r["same"] for r in df.collect()] == [True, True, False, None, None, True]


# ---- mixing


def test_solve_meets_goals(spark):
    rng = random.Random(3)
    cells = [(s, rng.randint(5, 4000), rng.randint(1, 9)) for s in "abc" for _ in range(80)]
    df = spark.createDataFrame(cells, "source string, n_tokens long, n long")
    want = {"a": (0.6, 3), "b": (0.3, 2), "c": (0.1, 4), "none": (0.0, 1)}
    plan = mixing.solve(df, want)
    used = defaultdict(float)
    for s, t, n in cells:
        p = plan[s]
        r = p["cap"] if math.isinf(p["lam"]) else min(p["cap"], math.exp(p["lam"] * t / p["mean"]))
        used[s] += t * n * r
    total = sum(used.values())
    assert all(used[s] / total == pytest.approx(want[s][0], abs=1e-5) for s in "abc")
    assert any(math.isinf(p["lam"]) for p in plan.values())
    assert mixing.solve(df.where("false"), want) == {}


def test_mix(spark):
    rows = [(i, s, "word " * (1 + i % 37)) for i, s in enumerate(["Big-One"] * 600 + ["small"] * 60 + ["other"] * 5)] + [(900, "small", ""), (901, None, "x"), (902, "small", None), (902, "small", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(1)).withColumn("rate", F.lit("z"))
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(docs, targets)
    got = uses.collect()
    assert len(got) == len(rows) and all(r["copies"] == 0 for r in got if r["source"] in ("other", None))
    assert max(r["copies"] for r in got if r["source"] == "small") <= 3 and max(r["copies"] for r in got if r["source"] == "big_one") <= 1
    shares = {r["source"]: r["actual_share"] for r in report.collect()}
    assert shares["big_one"] == pytest.approx(0.5, abs=0.01) and shares["small"] == pytest.approx(0.5, abs=0.01)
    none, _ = mixing.mix(docs.where("false"), targets)
    assert none.count() == 0


# ---- parsing


def test_gll_handles_ambiguity_and_left_recursion():
    g = Grammar("e: e + e | e '*' e | a | ( e )")
    assert g.accepts(("e",), ("a", "+", "a", "*", "a")) == {"e"} and not g.accepts(("e",), ("a", "+"))
    d = Grammar("x: a b* c?\ny: ( a | b )+")
    assert d.accepts(("x", "y"), ("a", "b", "b")) == {"x", "y"} and d.accepts(("x", "y"), ("a", "c")) == {"x"}


LISTS_JS = ["export {{ {} }} from 'm'", "f({})", "x = [{}]", "({}) => 1", "var {{ {} }} = o", "[{}] = o", "import {{ {} }} from 'm'", "x = {{ {} }}", "({})", "function f({}) {{}}", "export {{ {} }}"]
LISTS_PY = ["f({})", "x = [{}]", "x = ({})", "x = {{{}}}", "del ({})", "({}) = y", "from m import ({})", "x[{}]", "with ({}): pass", "lambda {}: 1"]


@pytest.mark.parametrize("form", LISTS_JS)
@pytest.mark.parametrize("item", ["a", "'a'", "1", "a = 1", "...a", "a as b", "a: b", "-a", "if", ""])
def test_javascript_lists_of_any_length(form, item):
    """The verdict of a list depends on its items, not on how many there are; nor does an odd one out get lost."""
    one = javascript_source.accepts(form.format(item + ", " + item))
    for n in (8, 9, 15, 16, 17, 18, 100, 3000):
        many = [item] * n
        assert javascript_source.accepts(form.format(", ".join(many))) == one, n
        for at in (0, n // 2, n - 1):
            assert not javascript_source.accepts(form.format(", ".join([*many[:at], "a b", *many[at + 1 :]])))


@pytest.mark.parametrize("form", LISTS_PY)
@pytest.mark.parametrize("item", ["a", "'a'", "1", "a=1", "*a", "**a", "a: b", "a as b", "-1", "a for a in b", "lambda a, b: c", ""])
def test_python_lists_of_any_length(form, item):
    for n in (2, 8, 9, 15, 16, 17, 100):
        for tail in ("", ",", ", 1", ", z=2", ", *z", ", **z"):
            text = form.format(", ".join([item] * n) + tail)
            if "a=1" not in item and "**" not in item and "=" not in tail or form in ("f({})", "lambda {}: 1"):
                got = python_source.accepts(text)
                assert got == python_ok(text), text[-60:]


GOOD_PY = [
    "", "\n\n# c\n", "x = 1", "def f(a, /, b=1, *c, d, **e) -> int: pass", "async def f():\n    async with a as b, c: await d\n    async for x in y: yield x\n", "match x:\n    case [1, *_] | {'a': b, **c} if d:\n        pass\n    case P(x=1) as q: pass\n",
    "match = 1; case = 2; type = 3; print(match)", "type A[T: int, *U] = list[T]", "x: int = yield", "f'{a!r:>{w}} {b=} {{}}'", 'f"{x["y"]}"', "lambda *a, k=1: (yield)", "try:\n  a\nexcept* (A, B) as c:\n  b\n", "with (a as b, c as d,): pass",
    "a[1:2, ::3, *b]", "x = *a, b", "if x:\n\ty\nelse:\n\tz", "class A[T](B, metaclass=C):\n  @d\n  def e(self): ...\n", "a = b = c; d += 1; del a, (b, c[0])", "from . import (a as b, c,)", "0xFF + 1_000j + .5e3 + 1if x else 2", "x = (\n  1,\n\n  # c\n 2)",
    "print(a for a in b)", "r'\\d' 'x' if 0 else rb'a' b'\\x00'", "not a is not b not in c", "a if b else lambda: c", "{**a, 'b': 1}; {*a, b}; {x: y for x in z}", "global a, b", "assert a, b", "x = 1 \\\n  + 2", "@a.b[c]\ndef f(): pass", "for x, *y in z: pass\nelse: pass", "(a.b) = 1", "case: int = 1", "'\\N{DASH}'" if False else "'\\N{BULLET}'",
]
BAD_PY = [
    "x = ", "def f(", "if x\n  y", "  x", "x = 'abc", "'''abc", "a b", "f(a b)", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> c", "print 'a'", "1 = x", "f() = 1", "x = 1a", "def f(a=1, b): pass", "f(a=1, b)", "f(**a, *b)", "if x:\nelse: y", "try:\n  a\n",
    "return = 1", "a := 1", "f'{a'", "f'{}'", "f'}'", "0123", "a ? b", "x = $", "'\\x1'", "'\\N{no such name}'", "b'é'", "'a' b'b'", "class A:\n", "\tx\n  y", "if a:\n    b\n  c", "match x:\n  pass\n", "except: pass", "for x in y z: pass", "(a, b): int = 1", "lambda: (yield", "import a.b as c.d", "del f()", "x = {1: 2, 3}", "None = 1", "with a as 1: pass", "[x for x in]", "else:\n  pass", "@\ndef f(): pass", "def f():\n    x = (\n", "x = )", "f(x for x in y, 1)", "async x = 1",
]


def python_ok(t):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(t)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize("text", GOOD_PY + BAD_PY)
def test_python_grammar(text):
    assert python_source.accepts(text) == python_ok(text) == (text in GOOD_PY)


def test_python_grammar_on_damaged_code(spark):
    """Texts cut, joined and with lines dropped get the interpreter's verdict."""
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/snippet_text.parquet").limit(120).collect()]
    wrong = 0
    for t in texts:
        lines = t.splitlines(keepends=True)
        for v in (t, t[: rng.randrange(len(t) + 1)], "".join(x for x in lines if rng.random() > 0.2), t.replace("(", "", 1), t.replace(":", "", 1)):
            wrong += python_source.accepts(v) != python_ok(v)
    assert wrong == 0


GOOD_JS = [
    "", "(a ?? b) || c", "(-1) ** 2", "2 ** -1", "0n", "0777", "089.5", "import {default as a} from 'x'", "export {default} from 'x'", "for(;;) if (x) break; else continue", "switch (a) { case 1: { break } }", "for (;;) switch (a) { case 1: continue }", "a: { break a }",
    "do break; while (0)", "for (const x of y) { try { break } finally { continue } }", "let\n[a] = b", "if (0) function f() {} else function g() {}", "<!-- html\nx = 1", "x\n--> y", "x = {break: 1}.break", "/(?<a>x)(?<b>y)/", "for (x in a, b) ;",
    "a\n++b", "x = y / 2 / z", "if (a) b\nelse c", "for (const x of y) z()", "async () => { await x }", "let {a, b: [c]} = d", "class A { #x = 1; static y; get z() { return 1 } static { f() } }", "`a${`b${c}`}`", "x?.y?.[1]?.(2)", "l: for(;;) { continue l }",
    "export default class {}", "import a, {b as c} from 'd'", "do x\nwhile(y)", "a = {b, c() {}, get d() { return 1 }, [e]: 1, ...f}", "function* g() { yield* x; yield }", "new Foo.Bar(1).baz", "(a, b) => ({a})", "x = function() {}\ny()", "if (a) { b } else if (c) { d }\nelse e",
    "switch (a) { case 1: b; break\ndefault: c }", "try { a } catch { b } finally { c }", "[a, b] = [b, a]", "({a} = b)", "async function f() { for await (const x of y) z }", "a ? b : c ? d : e", "/[/]/.test(x)", "x = a\n/b/c", "1_000n ** 2n", "await x", "// c", "x = {if: 1}", "a\n(b)",
    "if (x) return_1\n", "class B extends (A) {}", "let async = 1\nasync()", "x = async y => await y", "get = 1\nset = 2\nof = 3", "#!/bin/sh\nx", "'\\u{1F600}'", "a ??= b && c", "x = #p in y" if False else "class A { #p; has(y) { return #p in y } }", "if (a) delete b.c\nelse out.push(...d, { ...e, [`f`]: 1 })",
]
BAD_JS = [
    "a ?? b || c", "a && b ?? c", "-1 ** 2", "async function f() { await x ** 2 }", "0777n", "0_7", "07.5", "import {a as default} from 'x'", "export {default}", "export {if as x}", "function f() { break }", "if (x) continue", "switch (a) { case 1: continue }",
    "for (;;) { (() => { break })() }", "a: break\n", "while (1) let\n[a] = 1", "/(?<a>x)(?<a>y)/", "if (0) function* f() {}", "while (0) function f() {}", "class A { static { break } }", "<!-- html\nimport 'x'",
    "return 1", "let a = ", "function f( {", "{", "a b", "if (a", "x = {a: 1", "foo(", "1a", "'abc", "`abc", "/* x", "const a;", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "def f(x):\n    return x", "interface A { x: number; }", "function f(x: A): number { return 1 }", "for (x of) y", "new", "a +",
    "} ", "f(a b)", "f() = 1", "import {a from 'b'", "else x", "import re\nfrom .batch import load", "# title\n\ntext", ".a > .b { c: d; }", "'\\x1'", "a => {", "function () {}", "class { }", "/(/", "x = {a: 1,, b}", "({a = 1})", "function f() { await x }", "steps:\n  - run: make check",
]


@pytest.mark.parametrize("text", GOOD_JS + BAD_JS)
def test_javascript_grammar(text):
    assert javascript_source.accepts(text) == (text in GOOD_JS)


def test_bad_files(spark):
    s = spark.createDataFrame([("r", "./a.py", "1"), ("r", "a.py", "2"), ("r", "b.py", "1"), ("r", "c.js", "1"), ("r", "d.txt", "2"), ("q", "e.mjs", "3"), (None, "n.py", "2"), ("r", "g.py", "9"), ("r", None, "2")], "repo string, file_path string, snippet_id string").withColumn("text", F.lit("x"))
    t = spark.createDataFrame([("1", "def f():\n  pass\n"), ("2", "def f("), ("3", "let x = 1"), ("4", None), ("5", "x")], "snippet_id string, text string")
    assert {tuple(r) for r in parsing.bad_files(t, s).select("repo", "file_path").collect()} == {("r", "a.py"), ("r", "c.js"), (None, "n.py")}
    rate = {(r["repo"], r["language"]): (r["n_files"], r["n_bad"]) for r in parsing.bad_rates(t, s).collect()}
    assert rate["r", "python"] == (3, 1) and rate["q", "javascript"] == (1, 0) and rate[None, "python"] == (1, 1)
    assert parsing.bad_files(t.where("false"), s).count() == 0


# ---- abuse

CLEAN = ["the cache of the row is read twice", "please add a test for the parser", "this damn build ate my whole day", "kill the worker before the master restarts", "returns the old value of the field", "i was an idiot and forgot the lock", "the dump is ugly but it works", "see the notes for the order of keys"]
NASTY = ["you are a pathetic moron", "shut up you stupid clown", "go and hang yourself loser", "those people are vermin and should be banned", "send me a nude picture darling", "you worthless piece of garbage", "i will break your fingers", "nobody wants your kind here"]


def corpus(n, seed, twist=lambda x, r: x):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        parts = rng.sample(CLEAN, 3)
        toxic = i % 4 == 0
        if toxic:
            parts.insert(rng.randrange(4), twist(rng.choice(NASTY), rng))
        texts.append(". ".join(parts) + f" in v{i}")
        labels.append(int(toxic) if rng.random() > 0.04 else 1 - int(toxic))
    return texts, labels, [i % 4 == 0 for i in range(n)]


def gapped(x, rng):
    i = max(range(len(x.split())), key=lambda j: len(x.split()[j]))
    w = x.split()
    w[i] = rng.choice([w[i][:2] + "*" + w[i][2:], "-".join(w[i]), w[i].replace("o", "0").replace("i", "1"), w[i][:3] + w[i][2:], w[i].upper()])
    return " ".join(w)


def test_abuse_held_out():
    model = abuse.train(*corpus(400, 1)[:2], landmarks=120)
    texts, _, truth = corpus(200, 2, gapped)
    hit = model.score(texts) > abuse.THRESHOLD
    truth = np.array(truth)
    assert (hit & truth).sum() / truth.sum() > 0.9 and (hit & ~truth).sum() / (~truth).sum() < 0.05


def test_abuse_edges(spark):
    assert abuse.plain("c-r-e-t-i-n, sh\u00adut  UP l4zy idi0t `code_name` fooBar 12") == abuse.plain("cretin, shut up lazy idiot `x_y` foo_bar 7")
    assert np.isnan(abuse.train([], []).score(["", None])).all() and abuse.train(["a"], [0]).score(["some words here"])[0] == -1
    model = abuse.train(*corpus(200, 1)[:2], landmarks=60)
    assert model.score(["x " * 200_000 + ". you are a pathetic moron"])[0] > 0
    docs = spark.createDataFrame([(1, "A-b", "you are a pathetic moron"), (1, "A-b", "you are a pathetic moron"), (2, None, None), (3, "c", ""), (4, "c", "see the notes")], "doc_id long, source string, text string").withColumn("score", F.lit("x"))
    got = abuse.score_documents(docs, model).collect()
    assert len(got) == 5 and sum(r["flagged"] for r in got) == 2 and [r["score"] for r in got if r["doc_id"] in (2, 3)] == [None, None]
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (2, None)], "doc_id long, toxic int")
    assert [r["doc_id"] for r in abuse.rated(docs, labels).collect()] == [1]
    assert abuse.score_documents(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("text", ["you d_u_m_b_a_s_s.", "you D_U_M_B_4_S_S!", "you du_mb_as_s", "you dUmBaSs", "you dumb@ss", "you d_u_m_b_@_s_s"])
def test_abuse_disguise_outlives_code_names(text):
    assert abuse.plain(text) == "you dumbass"


def test_abuse_code_names_stay_masked():
    assert abuse.plain("@sshole") == "asshole" and abuse.plain("b@stard") == "bastard"
    assert abuse.plain("see row_id parse_config x_y toUpperCase isOk f() `a_b_c` #12") == abuse.plain("see `a()` `b=1` `c.d` `d[0]` `e{}` `f_f` `g/h` #1")


def test_abuse_short_and_quoted_passages():
    assert abuse.passages("KYS! Die.") == [" kys ", " die "] and abuse.passages("You suck. KYS.") == ["you suck", " kys "]
    assert abuse.passages("`you idiot`") == ["you idiot"] and abuse.passages("#idiot, @idiot") == ["idiot", "aidiot"]
    assert abuse.passages("... !? `x_y`") in ([], ["#"], [" # "])
    words = [(a, b) for a in "row key list node path tree heap leaf".split() for b in "one two six ten log map set job cat dog end pin tap top van".split()]
    texts = [f"see the {a} of {b}. " + ("KYS." if i % 3 == 0 else "try it.") for i, (a, b) in enumerate(words)]
    model = abuse.train(texts, [int(i % 3 == 0) for i in range(120)], landmarks=40)
    s = model.score(["all is well. KYS!", "all is well. try it.", "kys", "try"])
    assert s[0] > 0 > s[1] and s[2] > 0 > s[3]


def test_abuse_training_bounds(spark):
    texts, labels, _ = corpus(120, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rates = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "doc_id long, toxic int")
    a, b = abuse.fit(docs, rates), abuse.fit(docs.repartition(5), rates.repartition(3))
    assert a.bias == b.bias and (a.table == b.table).all() and a.score(["you are a pathetic moron"])[0] > 0
    assert abuse.fit(docs, rates, max_chars=0).score(["some words"])[0] == -1 and abuse.fit(docs, rates.where("false")).bias == -1


# ---- the queries

from skein.llm.queries import ORACLE, QUERIES  # noqa: E402
from tests.oracle import compare  # noqa: E402


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, n, _, _ = compare(spark, name, "/root/testdata/sf0.001")
    assert ok is not False and (n > 0 or name == "p8_found") and set(ORACLE) <= set(QUERIES)
