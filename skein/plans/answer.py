"""Answering a question: route it, run the one DataFrame it needs, and write the text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import callgraph, lineage
from .router import classify
from .store import VersionedIndex


@dataclass
class Answer:
    route: str
    kind: str | None = None
    names: tuple[str, ...] = ()
    rows: DataFrame | None = None
    text: str = ""
    results: list[dict] = field(default_factory=list)


# fixed values: the wording of the answers, here and in all functions below
_TITLES = {
    "callers": "Functions that call {0}",
    "callees": "What {0} calls",
    "definition": "Definition of {0}",
    "before": "Functions that call {0} before {1} (source order within the function)",
    "transitive": "Everything that directly or indirectly calls {0}",
}


def _many(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def _where(r: dict) -> str:
    return f"{r['qualname']}  " + ("(top-level code)" if r["kind"] == "module" else f"(lines {r['line_start']}-{r['line_end']})")


def _detail(kind: str, r: dict) -> str:
    if kind == "callers":
        return "; calls at line " + ", ".join(str(x) for x in r["call_lines"])
    if kind == "before":
        return f"; first call line {r['first_call_line']}, later call line {r['later_call_line']}"
    if kind == "transitive":
        return f"; distance {r['depth']} (via {r['via']})"
    return ""


def describe(kind: str, names: tuple[str, ...], results: list[dict], known: bool = True) -> str:
    """The results as text, by file."""
    title = _TITLES[kind].format(names[0], names[-1])
    if not results:
        return f"{title}: none found." + ("" if known else f" No function or class named '{names[0]}' is indexed.")
    spans = [(r["file_path"], _where(r)) for r in results]
    lines = [f"{title} ({_many(len(set(spans)) if kind == 'callees' else len(results), 'result')}):"]
    for path in dict.fromkeys(p for p, _ in spans):
        lines.append(f"  {path}")
        shown = called = None
        for r in (x for x in results if x["file_path"] == path):
            if kind != "callees":
                lines.append(f"    {_where(r)}{_detail(kind, r)}")
                continue
            if shown != _where(r):
                shown, called = _where(r), None
                lines.append(f"    {shown}")
            if called == (r["callee_name"], r["line"]):
                lines[-1] += f", {r['defined_at']}"  # one more place of the same callee
                continue
            called = (r["callee_name"], r["line"])
            lines.append(f"      calls {r['callee_name']} at line {r['line']}" + (f" -> {r['defined_at']}" if r["defined_at"] else " (not defined in the indexed code)"))
    return "\n".join(lines)


def describe_history(name: str, rows: list[dict]) -> str:
    """Lineages and their versions (rows of ``VersionedIndex.history``) as text, with what changed where diffs are there."""
    if not rows:
        return f"History of {name}: no function named '{name}' in the versioned index."
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lineage_id"], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r["seq_added"], r["row_id"]))
    order = sorted(groups, key=lambda k: (groups[k][-1]["file_path"], groups[k][-1]["qualname"], k))
    out = [f"History of {name} ({_many(len(groups), 'lineage')}):"]
    for k in order:
        last = groups[k][-1]
        out.append(f"  {last['file_path']}::{last['qualname']}  ({_many(len(groups[k]), 'version')})")
        for r in groups[k]:
            span = lineage.span(r["version_added"], r["valid_through"])
            out.append(f"    {span:<8} {r['change']:<9} {r['file_path']}:{r.get('line_start', '')}-{r.get('line_end', '')}")
            if r.get("diff"):
                out += ["      " + x for x in r["diff"].splitlines() if x.startswith(("+", "-")) and not x.startswith(("+++", "---"))]
            elif r.get("diff_note"):
                out.append(f"      (diff {r['diff_note']})")
    return "\n".join(out)


def _shown(rows: DataFrame, most: int) -> tuple[list[dict], str]:
    """The first rows of an answer, and a line that says so where there are more."""
    found = [r.asDict() for r in rows.limit(most + 1).collect()]
    return found[:most], "" if len(found) <= most else f"\n(only the first {most} rows are shown)"


def answer(query: str, defs: DataFrame | None, calls: DataFrame | None, semantic: Callable[[str], DataFrame] | None = None, history: VersionedIndex | None = None, most: int = 1000) -> Answer:
    """Route a question and answer it. ``rows`` is the whole answer and stays lazy; for the text, its first ``most`` rows
    come to the driver."""
    intent = classify(query)
    if intent is None:
        if semantic is None:
            return Answer("semantic", text="Not a call-graph question; use the semantic retrieval pipeline.")
        rows = semantic(query)
        found, more = _shown(rows, most)
        return Answer("semantic", rows=rows, text=f"{len(found)} semantic results{more}", results=found)
    a = intent.names
    if intent.kind == "history":
        if history is None:
            return Answer("history", "history", a, text="This is a version-history question; no versioned index was supplied.")
        rows = history.history(a[0], with_diffs=True)
        found, more = _shown(rows, most)
        return Answer("history", "history", a, rows, describe_history(a[0], found) + more, found)
    if defs is None or calls is None:
        raise ValueError("a structural question needs a call graph")
    rows = {
        "callers": lambda: callgraph.callers(defs, calls, a[0]),
        "callees": lambda: callgraph.callees(defs, calls, a[0]),
        "definition": lambda: callgraph.definition(defs, a[0]),
        "before": lambda: callgraph.calls_before(defs, calls, a[0], a[-1]),
        "transitive": lambda: callgraph.transitive_callers(defs, calls, a[0]),
    }[intent.kind]()
    found, more = _shown(rows, most)
    known = bool(found) or callgraph.is_defined(defs, a[0])
    return Answer("structural", intent.kind, a, rows, describe(intent.kind, a, found, known) + more, found)
