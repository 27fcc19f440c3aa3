"""Definitions and calls of a Python file, from the interpreter's own syntax tree."""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
import warnings


def _hash(source: str, strip_comments: bool) -> tuple[str, int]:
    """A hash over the tokens, blind to layout, and the number of tokens that are code."""
    parts, code = [], 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type in (tokenize.NL, tokenize.NEWLINE, tokenize.ENDMARKER):
                continue
            if t.type == tokenize.COMMENT:
                if not strip_comments:
                    parts.append("#" + t.string.rstrip())
                continue
            name = tokenize.tok_name[t.type]
            parts.append(name if t.type in (tokenize.INDENT, tokenize.DEDENT) else f"{name} {t.string}")
            code += t.type not in (tokenize.INDENT, tokenize.DEDENT) and t.string != ";"
    except (tokenize.TokenError, IndentationError, SyntaxError):
        parts, code = source.split(), len(source.split())
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16], code


def _dedent(lines: list[str], col: int) -> str:
    return "".join(x[col:] if not x[:col].strip() else x for x in lines)


class _Finder(ast.NodeVisitor):
    def __init__(self) -> None:
        self.defs: list[dict] = []
        self.calls: dict[int, list[dict]] = {-1: []}
        self.alias: dict[str, str] = {}
        self.owner, self.cls = -1, None

    def _inside(self, node, owner: int, cls: str | None, fields) -> None:
        keep = self.owner, self.cls
        self.owner, self.cls = owner, cls
        for f in fields:
            v = getattr(node, f, None)
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, ast.AST):
                    self.visit(x)
        self.owner, self.cls = keep

    def _function(self, node) -> None:
        for d in node.decorator_list:
            self.visit(d)
        me = len(self.defs)
        self.defs.append({"node": node, "name": node.name, "qualname": f"{self.cls}.{node.name}" if self.cls else node.name, "kind": "method" if self.cls else "function"})
        self.calls[me] = []
        self._inside(node, me, None, ("type_params", "args", "returns", "body"))

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.defs.append({"node": node, "name": node.name, "qualname": node.name, "kind": "class"})
        self._inside(node, self.owner, node.name, ("type_params", "bases", "keywords", "body"))

    def _import(self, node) -> None:
        for a in node.names:
            if a.asname:
                self.alias[a.asname] = a.name.rsplit(".", 1)[-1]

    visit_Import = visit_ImportFrom = _import

    def visit_Call(self, node) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.calls[self.owner].append({"callee": f.id, "line": f.lineno, "col": f.col_offset, "receiver": None})
        elif isinstance(f, ast.Attribute):
            self.calls[self.owner].append({"callee": f.attr, "line": f.end_lineno, "col": f.end_col_offset - len(f.attr.encode()), "receiver": ast.unparse(f.value)})
        self.generic_visit(node)


def extract(source: str, for_versioning: bool = False, strip_comments: bool = False) -> list[dict]:
    """Definitions in source order, each with its calls; the code outside definitions last, as ``<module>``.

    Text that does not parse has no definitions.
    """
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.splitlines(keepends=True)
    found = _Finder()
    found.visit(tree)
    out, hidden = [], set()
    for i, d in enumerate(found.defs):
        n = d["node"]
        part = lines[n.lineno - 1 : n.end_lineno]
        text = _dedent(part, n.col_offset)
        hidden.update(range(n.lineno, n.end_lineno + 1))
        out.append({k: d[k] for k in ("name", "qualname", "kind")} | {"line_start": n.lineno, "line_end": n.end_lineno, "text": text, "snippet_id": _hash(text, strip_comments)[0], "calls": found.calls.get(i, [])})
    rest = "".join(x for i, x in enumerate(lines, 1) if i not in hidden)
    ident, code = _hash(rest, strip_comments)
    if found.calls[-1] or (for_versioning and code):
        end = source.count("\n") + 1
        out.append({"name": "<module>", "qualname": "<module>", "kind": "module", "line_start": 1, "line_end": end, "text": rest, "snippet_id": ident, "calls": found.calls[-1]})
    for d in out:
        calls = sorted(d["calls"], key=lambda c: (c["line"], c["col"]))
        for c in calls:
            if c["receiver"] is None:
                c["callee"] = found.alias.get(c["callee"], c["callee"])
        d["calls"] = [c | {"order": i} for i, c in enumerate(calls)]
    return out
