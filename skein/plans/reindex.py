"""Re-indexing compared: edits of known kinds, a full build, an incremental one, and whether they end the same."""

from __future__ import annotations

import ast
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import spread_row_number
from .store import VersionedIndex, equivalent

#: The kinds of edits, dealt to the edited files in turn.
KINDS = ("modify", "add_function", "delete_function", "move_function", "reformat", "add_comment")


def _top_function(tree: ast.Module):
    return next((n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None)


def edit(code: str, kind: str, number: int) -> tuple[str, str, str | None]:
    """``(new code, kind applied, function moved elsewhere)``. Where there is no function to take out, a number is changed;
    where there is no number either, a statement is added."""
    tree, lines = ast.parse(code), code.splitlines(keepends=True)
    if kind == "add_comment":
        return f"# seen {number}\n{code}", kind, None
    if kind == "add_function":
        return f"{code}\n\ndef added_{number}(value):\n    return value + {number}\n", kind, None
    if kind == "reformat":
        before = {min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) for n in tree.body}
        return "".join(("\n" if i in before else "") + x for i, x in enumerate(lines, 1)), kind, None
    found = _top_function(tree) if kind in ("delete_function", "move_function") else None
    if found is not None:
        a, b = found.lineno - 1, found.end_lineno
        rest = "".join(lines[:a] + lines[b:])
        try:
            ast.parse(rest)
        except SyntaxError:  # a decorator is left without its function
            rest = "".join(lines[: min(d.lineno for d in found.decorator_list) - 1] + lines[b:])
        return rest if rest.strip() else "pass\n", kind, "".join(lines[a:b]) if kind == "move_function" else None
    for n in ast.walk(tree):
        if isinstance(n, ast.Constant) and type(n.value) is int and n.lineno == n.end_lineno and lines[n.lineno - 1].isascii():
            x = lines[n.lineno - 1]
            lines[n.lineno - 1] = f"{x[: n.col_offset]}{n.value + 1}{x[n.end_col_offset :]}"
            return "".join(lines), "modify", None
    return f"{code}changed_{number} = {number}\n", "modify", None


def edited(files: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The listing ``file_path, content, file_hash`` with ``k`` Python files edited, each kind in turn; one edit is a ``modify``.

    Functions that move get files of their own. All other files stay as they are.
    """
    order = F.xxhash64(F.lit(seed), "file_path")
    picked = files.select("file_path", "content").orderBy(order, "file_path").limit(k)
    picked = spread_row_number(picked.withColumns({"_g": F.lit(0), "_h": order}), ["_g"], ["_h", "file_path"])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                i = int(r.rn) - 1
                code, _, moved = edit(bytes(r.content).decode("utf-8"), KINDS[i % len(KINDS)] if k > 1 else "modify", i)
                out.append((r.file_path, code.encode()))
                if moved:
                    out.append((f"pkg_moved/moved_{i:05d}.py", moved.encode()))
            yield pd.DataFrame(out, columns=["file_path", "content"])

    new = picked.select("file_path", "content", "rn").mapInPandas(run, "file_path string, content binary").withColumn("file_hash", F.sha2("content", 256))
    rest = files.select("file_path", "content", "file_hash").join(picked.select("file_path"), "file_path", "left_anti")
    return rest.unionByName(new)


def compare(spark: SparkSession, files: DataFrame, k: int, path: str, seed: int = 0, queries: DataFrame | None = None) -> dict:
    """Seconds of indexing ``files``, of the edited listing on top, and of the edited listing alone; and whether the two
    stores are equivalent."""
    after = edited(files, k, seed)
    one, two = VersionedIndex(spark, f"{path}/incremental"), VersionedIndex(spark, f"{path}/full")
    out: dict = {}
    for name, ix, listing, label in (("first", one, files, "v1"), ("incremental", one, after, "v2"), ("full", two, after, "v2")):
        t = time.perf_counter()
        s = ix.index_version(listing, label)
        out[name] = {"wall_seconds": round(time.perf_counter() - t, 3), "phase_seconds": s.seconds, "files_total": s.files_total, "files_changed": s.files_changed, "files_parsed": s.files_parsed, "snippets_total": s.snippets_total, "texts_embedded": s.texts_embedded, "counts": s.counts}
    out["speedup"] = round(out["full"]["wall_seconds"] / out["incremental"]["wall_seconds"], 2)
    out["equivalent"] = equivalent(one, two, queries)
    return out
