"""Definitions and calls of a JavaScript file, from its tokens and their nesting."""

from __future__ import annotations

import hashlib
import re

_TOKEN = re.compile(
    r"""(?P<gap>\s+)|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")|(?P<num>\.?\d[\w.]*)|(?P<id>[#A-Za-z_$][\w$]*)|(?P<op>=>|\?\.|\.\.\.|[-+*/%&|^<>=!?]=?|[^\s\w])"""
)
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: A piece of a template literal, up to its end or to a substitution.
_PIECE = re.compile(r"[`}](?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)")
_WORDS = frozenset(
    "if for while switch catch return function typeof delete void new in of instanceof do else case throw await yield with super import class extends var let const async get set static".split()
)
_NOT_CALLED = frozenset("if for while switch catch function with return typeof delete void super import await yield in of case throw require".split())


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """``kind, text, line, col`` without blanks; patterns are told from divisions by what precedes them. The pieces of a
    template literal are tokens, and so is what stands in its substitutions."""
    out, pos, line, start = [], 0, 1, 0
    last = ""
    within: list[int] = []  # open braces in each substitution that is being read
    while pos < len(source):
        m = None
        piece = source[pos] == "`" or (source[pos] == "}" and within and within[-1] == 0)
        if piece:
            m = _PIECE.match(source, pos)
            if m and source[pos] == "}":
                within.pop()
            if m and m.group().endswith("${"):
                within.append(0)
        elif source[pos] == "/" and source[pos + 1 : pos + 2] not in ("/", "*") and (not last or last in "([{,;=:!&|?+-*%<>~^" or last in _WORDS or last == "=>"):
            m = _PATTERN.match(source, pos)
        kind = "tpl" if piece and m else "str" if m else ""
        m = m or _TOKEN.match(source, pos)
        if not m:
            pos += 1
            continue
        kind = kind or m.lastgroup
        text = m.group()
        if kind != "gap":
            out.append((kind, text, line, pos - start))
            if kind != "com":
                last = "{" if kind == "tpl" and text.endswith("${") else text
            if within and kind == "op":
                within[-1] += (text == "{") - (text == "}")
        if "\n" in text:
            line += text.count("\n")
            start = pos + text.rfind("\n") + 1
        pos = m.end()
    return out


class _Tokens(list):
    """Tokens without comments, and for each opening bracket the index of the one that closes it."""

    def __init__(self, toks: list):
        super().__init__(toks)
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(toks):
            if t[0] == "op" and t[1] in "([{":
                open_.append(i)
            elif t[0] == "op" and t[1] in ")]}" and open_:
                self.close[open_.pop()] = i


def _closing(toks: _Tokens, i: int) -> int:
    """Index of the bracket that closes the one at ``i``, the last token if none does."""
    return toks.close.get(i, len(toks) - 1)


def _arrow_end(toks: list, i: int) -> int:
    """Last token of the expression that starts at ``i``."""
    j = i
    while j < len(toks):
        t = toks[j]
        if t[0] == "op":
            if t[1] in "([{":
                j = _closing(toks, j)
            elif t[1] in ")]},;":
                return j - 1
        j += 1
    return len(toks) - 1


def _definitions(t: list) -> list[dict]:
    """``name, qualname, kind, a, b, body`` with token indexes, outer ones first."""
    found, classes = [], []
    text = lambda i: t[i][1] if 0 <= i < len(t) else ""
    named: set[int] = set()

    def add(name: str, start: int, body: int, owner: str | None, kind: str | None = None) -> None:
        end = _closing(t, body) if text(body) == "{" else _arrow_end(t, body)
        found.append({"name": name, "qualname": f"{owner}.{name}" if owner else name, "kind": kind or ("method" if owner else "function"), "a": start, "b": end, "body": body})

    def value(i: int) -> int | None:
        """Token at which the body of the function expression at ``i`` starts."""
        if text(i) == "async":
            i += 1
        if text(i) == "function":
            i += 1 + (text(i + 1) == "*")
            i += t[i][0] == "id" if i < len(t) else 0
            return _closing(t, i) + 1 if text(i) == "(" else None
        j = _closing(t, i) + 1 if text(i) == "(" else i + 1 if i < len(t) and t[i][0] == "id" else len(t)
        return j + 1 if text(j) == "=>" else None

    for i in range(len(t)):
        w = text(i)
        if w == "class" and t[i][0] == "id" and text(i - 1) != ".":
            j = i + 1
            name = text(j) if t[j : j + 1] and t[j][0] == "id" and text(j) != "extends" else None
            while j < len(t) and text(j) != "{":
                j += 1
            if j < len(t):
                owner = name or (text(i - 2) if text(i - 1) == "=" else "")
                classes.append((j, _closing(t, j), owner))
                if owner:
                    found.append({"name": owner, "qualname": owner, "kind": "class", "a": i, "b": _closing(t, j), "body": j})
        elif w == "function" and text(i - 1) != "." and i not in named:
            j = i + 1 + (text(i + 1) == "*")
            if j < len(t) and t[j][0] == "id":
                add(text(j), i - (text(i - 1) == "async"), _closing(t, j + 1) + 1, None)
        elif w == "=" and i and t[i - 1][0] == "id":
            body = value(i + 1)
            if body and body < len(t):
                named.update((i + 1, i + 2))
                if text(i - 2) == ".":
                    owner = text(i - 3)
                    if owner == "prototype" and text(i - 4) == ".":
                        owner = text(i - 5)
                    owner = None if owner in ("exports", "this") else owner
                    k = i - 1
                    while text(k - 1) == ".":
                        k -= 2
                    add(text(i - 1), k, body, owner)
                else:
                    add(text(i - 1), i - 1, body, None)
        elif w == ":" and i and t[i - 1][0] == "id" and text(i - 2) in ("{", ","):
            body = value(i + 1)
            if body and body < len(t):
                named.update((i + 1, i + 2))
                add(text(i - 1), i - 1, body, None)
    for a, b, owner in classes:
        i = a + 1
        while i < b:
            start = i
            while text(i) in ("static", "async", "get", "set", "*") and text(i + 1) != "(":
                i += 1
            if t[i][0] in ("id", "str") and text(i + 1) == "(":
                close = _closing(t, i + 1)
                if text(close + 1) == "{":
                    add(text(i).strip("'\""), start, close + 1, owner or None, "method")
                    i = _closing(t, close + 1) + 1
                    continue
            i = _closing(t, i) + 1 if text(i) in ("{", "(", "[") else i + 1
    return sorted(found, key=lambda d: (d["a"], -d["b"]))


def _aliases(t: list) -> dict[str, str]:
    out = {}
    for i, (k, w, _, _) in enumerate(t):
        if k == "op" and w == "{":
            end = _closing(t, i)
            source = (i and t[i - 1][1] in ("import", "const", "let", "var", ",")) and end + 1 < len(t) and t[end + 1][1] in ("from", "=")
            for j in range(i + 1, end - 1) if source else ():
                if t[j][0] == "id" and t[j + 1][1] in ("as", ":") and t[j + 2][0] == "id":
                    out[t[j + 2][1]] = t[j][1]
    return out


def _hash(toks: list, strip_comments: bool) -> str:
    return hashlib.sha256("\0".join(x[1] for x in toks if not (strip_comments and x[0] == "com")).encode()).hexdigest()[:16]


def extract(source: str, for_versioning: bool = False, strip_comments: bool = False) -> list[dict]:
    """Definitions in source order, each with its calls; the code outside definitions last, as ``<module>``."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    every = tokens(source)
    t = _Tokens([x for x in every if x[0] != "com"])
    defs = _definitions(t)
    alias = _aliases(t)
    funcs = [d for d in defs if d["kind"] != "class"]
    calls: dict[int, list[dict]] = {-1: [], **{id(d): [] for d in funcs}}
    # tokens that name a definition: before its parameter list
    own = {i for d in funcs for i in range(d["a"], min(d["a"] + 8, d["body"])) if t[i][1] == d["name"] and i + 1 < len(t) and t[i + 1][1] == "(" and _closing(t, i + 1) + 1 == d["body"]}
    starts = sorted(funcs, key=lambda d: d["a"])
    inside: list[dict] = []
    n = 0
    for i, (k, w, line, col) in enumerate(t[:-1]):
        while n < len(starts) and starts[n]["a"] <= i:
            inside.append(starts[n])
            n += 1
        while inside and inside[-1]["b"] < i:
            inside.pop()
        nxt = t[i + 1][1]
        made = i and t[i - 1][1] == "new"
        if k != "id" or w in _NOT_CALLED or w in ("new", "async") or i in own or not (nxt == "(" or (nxt == "?." and i + 2 < len(t) and t[i + 2][1] == "(") or made):
            continue
        dotted = i and t[i - 1][1] in (".", "?.")
        owner = id(inside[-1]) if inside else -1
        calls[owner].append({"callee": w if dotted else alias.get(w, w), "line": line, "col": col, "receiver": t[i - 2][1] if dotted and i > 1 else None})
    lines = source.splitlines(keepends=True)
    out = []
    at = {(x[2], x[3]): n for n, x in enumerate(every)}
    hidden: set[int] = set()
    for d in defs:
        a, b = t[d["a"]], t[d["b"]]
        part = every[at[a[2:]] : at[b[2:]] + 1]
        hidden.update(range(at[a[2:]], at[b[2:]] + 1))
        end = b[2] + b[1].count("\n")
        text = "".join(lines[a[2] - 1 : end])
        cut = len(lines[a[2] - 1]) - len(lines[a[2] - 1].lstrip()) if lines[a[2] - 1 : a[2]] else 0
        text = "".join(x[cut:] if not x[:cut].strip() else x for x in text.splitlines(keepends=True))
        out.append({k: d[k] for k in ("name", "qualname", "kind")} | {"line_start": a[2], "line_end": end, "text": text, "snippet_id": _hash(part, strip_comments), "calls": calls.get(id(d), [])})
    rest = [x for n, x in enumerate(every) if n not in hidden]
    code = [x for x in rest if x[0] != "com" and x[1] != ";"]
    if calls[-1] or (for_versioning and code):
        out.append({"name": "<module>", "qualname": "<module>", "kind": "module", "line_start": 1, "line_end": source.count("\n") + 1, "text": " ".join(x[1] for x in rest), "snippet_id": _hash(rest, strip_comments), "calls": calls[-1]})
    for d in out:
        d["calls"] = [c | {"order": i} for i, c in enumerate(sorted(d["calls"], key=lambda c: (c["line"], c["col"])))]
    return out
