"""JavaScript (ES2023, script and module): tokens, bracket groups and statements, recognised by generalised LL.

The goals run together: words that one goal reserves and the other does not are tokens of both kinds.
"""

from __future__ import annotations

import re

from .gll import MEMORY, Grammar, Invalid

# fixed values: the language's words
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
CONTEXT = frozenset("async of get set static let from as".split())

_CLASSES = {w: frozenset((w, "IDNAME")) for w in RESERVED} | {w: frozenset((w, "NAME", "IDNAME")) for w in CONTEXT}
_CLASSES |= {w: frozenset(("PRE", "IDNAME")) for w in ("typeof", "void", "delete")} | {w: frozenset(("LIT", "IDNAME")) for w in ("this", "null", "true", "false")}
_CLASSES |= {
    "NAME": frozenset(("NAME", "IDNAME")), "instanceof": frozenset(("BINOP", "IDNAME")), "return!": frozenset(("IDNAME",)), "AWAIT": frozenset(("AWAIT", "IDNAME")),
    "await0": frozenset(("AWAIT", "NAME", "IDNAME")), "YIELD": frozenset(("YIELD", "IDNAME")),
    "break!": frozenset(("break!", "IDNAME")), "continue!": frozenset(("continue!", "IDNAME")), "let[": frozenset(("let", "let[", "IDNAME")),
}

GRAMMAR = r"""
expr: assign ( , assign )*
assign: cond | arrow | YIELD | YIELD assign | YIELD STAR assign | target = assign | target ASSIGNOP assign | apat = assign
cond: bin | bin '?' assign ':' assign
bin: ops ( LOGIC ops )* | ops ( '??' ops )+
ops: pow ( binop pow )* | PRIV in pow ( binop pow )*
binop: BINOP | STAR | SIGN | in
pow: un | upd '**' pow
un: PRE un | SIGN un | AWAIT un | upd
upd: INC target | post
post: lhs | target INC
lhs: prim suf*
prim: NAME | LIT | NUMBER | STRING | REGEX | TPL | arr | obj | paren | funcx | classx | new lhs | new . NAME | super | import args | import . NAME
suf: . IDNAME | . PRIV | sub | args | TPL | '?.' IDNAME | '?.' PRIV | '?.' sub | '?.' args
target: NAME | lhs . IDNAME | lhs . PRIV | lhs sub | ptgt
funcx: async? function STAR? NAME? params blk
heir: extends lhs
classx: class NAME? heir? cls
arrow: async? NAME => abody | async? params => abody
abody: blk | !BR assign
eos: ; | NLS | END
item: stmt | decl | NLS | END
vdecl: NAME ( = assign )? | bpat = assign
vdecls: vdecl ( , vdecl )*
cdecl: NAME = assign | bpat = assign
cdecls: cdecl ( , cdecl )*
func: async? function STAR? NAME params blk
decl: func | class NAME heir? cls | let vdecls eos | const cdecls eos
estmt: !BR !function !class !let[ expr eos
stmt: blk | ; | var vdecls eos | estmt | if paren branch ( else branch )? | do stmt NLS? while paren ;? | while paren stmt | for head stmt | for AWAIT head stmt
 | continue NAME? eos | break NAME? eos | continue! NAME eos | break! NAME eos | return expr? eos | with paren stmt | switch paren cas | NAME ':' stmt | NAME ':' func | throw expr eos | try blk handler | debugger eos
branch: stmt | function NAME params blk
handler: catch cparam? blk ( finally blk )? | finally blk
seg_: item*
clause: NAME | STAR as NAME | ispec | NAME , STAR as NAME | NAME , ispec
attrs: with obj
xname: IDNAME | STRING
top: import STRING attrs? eos | import clause from STRING attrs? eos
 | export default func | export default async? function STAR? params blk | export default class NAME? heir? cls | export default !function !class assign eos
 | export spec from STRING attrs? eos | export lspec eos | export STAR ( as xname )? from STRING attrs? eos | export decl | export var vdecls eos
top_: ( item | top )*
script_: item*
arg: ... assign | assign
args_: | arg ( , arg )* ,?
paren_: expr
fparam: NAME ( = assign )? | bpat ( = assign )?
frest: ... NAME | ... bpat
brest: ... binder
arest: ... each
obrest: ... NAME
oarest: ... target
params_: | fparam ( , fparam )* ,? | fparam ( , fparam )* , frest | frest
binder: NAME | bpat
kind: var | let | const
head_: ( var vdecls | let vdecls | const cdecls | expr )? ; expr? ; expr? | kind binder of assign | kind binder in expr | each of assign | each in expr
each: target | apat
cparam_: binder
ptgt_: target
arr_: arg? ( , arg? )*
sub_: expr
bel: binder ( = assign )?
abpat_: bel? ( , bel? )* | ( bel? , )* brest
ael: each ( = assign )?
aapat_: ael? ( , ael? )* | ( ael? , )* arest
pname: IDNAME | STRING | NUMBER | sub
method: pname params blk | ( get | set | async ) pname params blk | STAR pname params blk | async STAR pname params blk
prop: NAME | pname ':' assign | method | ... assign
obj_: | prop ( , prop )* ,?
bprop: NAME ( = assign )? | pname ':' binder ( = assign )?
obpat_: | bprop ( , bprop )* ,? | ( bprop , )* obrest
aprop: NAME ( = assign )? | pname ':' each ( = assign )?
oapat_: | aprop ( , aprop )* ,? | ( aprop , )* oarest
sname: xname ( as xname )?
spec_: | sname ( , sname )* ,?
iname: NAME | xname as NAME
ispec_: | iname ( , iname )* ,?
lname: NAME ( as xname )?
lspec_: | lname ( , lname )* ,?
cname: pname | PRIV
cmethod: cname params blk | ( get | set | async ) cname params blk | STAR cname params blk | async STAR cname params blk
celem: ; | NLS | END | static? cmethod | static? cname ( = assign )? eos | static blk
cls_: celem*
cas_: ( case expr ':' | default ':' | item )*
whole: expr
"""

_ITEMS = ("arg", "assign", "fparam", "frest", "bel", "brest", "ael", "arest", "prop", "bprop", "obrest", "aprop", "oarest", "sname", "iname", "lname")
JS = Grammar(GRAMMAR, _CLASSES, _ITEMS)
_GROUPS: dict[tuple, str] = {}
_NAMES = {"abpat_": "bpat", "obpat_": "bpat", "aapat_": "apat", "oapat_": "apat", "seg_": "blk"}
_PAREN, _BRACKET, _BRACE = ("args_", "paren_", "params_", "cparam_", "ptgt_"), ("arr_", "sub_", "abpat_", "aapat_"), ("obj_", "obpat_", "oapat_", "spec_", "ispec_", "lspec_")
_SEGS = ("seg_", "cls_", "cas_")
_CLOSE = {")": "(", "]": "[", "}": "{"}

_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)+")
_TOK = re.compile(
    r"""(#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|\.(?!\d)|[{}()\[\];,<>+\-*/%&|^!~?:=])|(0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[0-7]+(?![0-9])|0[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:_[0-9]+)*(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?|(?:0|[1-9](?:_?[0-9])*)n|(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?)|('(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*")|(`)"""
)
_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+)/([A-Za-z0-9_$]*)")
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:10)?[0-9a-fA-F]{1,5}\}))")
_OCTAL = re.compile(r"0[0-7]+$")
_GROUP = re.compile(r"\(\?<([^=!>][^>]*)>")
_ESCAPED = re.compile(r"\\[^xu]")
_PUNCT = {"+": "SIGN", "-": "SIGN", "!": "PRE", "~": "PRE", "*": "STAR", "++": "INC", "--": "INC"}
_PUNCT |= {o: "BINOP" for o in ("/", "%", "<<", ">>", ">>>", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "&", "|", "^")} | {"&&": "LOGIC", "||": "LOGIC"}
_PUNCT |= {o: "ASSIGNOP" for o in ("+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")}
#: Kinds before which a line end may stand for a semicolon, and words that go on with a statement.
_LATER = frozenset(("in", "instanceof", "extends"))
_AFTER_BLOCK = frozenset(("else", "catch", "finally", "while"))
_HEADS = frozenset(("if", "for", "while", "switch", "with", "catch"))
_OPEN_ENDED = frozenset(RESERVED - {"break", "continue", "debugger", "false", "null", "return", "super", "this", "true"})


def _can_end(k: str) -> bool:
    return k not in _OPEN_ENDED and (k[0].isalpha() or k[0] in "([{") and k not in ("BINOP", "LOGIC", "SIGN", "STAR", "PRE", "ASSIGNOP", "NLS")


def _can_start(k: str) -> bool:
    return k[0] == "{" or k in ("INC", "PRE", "TPL?") or (k[0].isalpha() and k not in _LATER and k not in ("BINOP", "LOGIC", "SIGN", "STAR", "ASSIGNOP", "TPL", "NLS"))


def _segments(kinds: list[str]) -> list[list[str]]:
    """Statement lists cut behind semicolons and line ends that end a statement."""
    out, seg = [], []
    n = len(kinds)
    for i, k in enumerate(kinds):
        seg.append(k)
        if k in (";", "NLS") and not (i + 1 < n and (kinds[i + 1] == "else" or (kinds[i + 1] == "while" and "do" in seg))):
            out.append(seg)
            seg = []
    seg.append("END")
    out.append(seg)
    return out


def _close(opening: str, kinds: list[str], head: bool = False) -> str:
    """The kind of the group between two brackets; ``head``: those behind ``for``."""
    inner = tuple(kinds)
    key = (opening, inner, head)
    made = _GROUPS.get(key)
    if made is None:
        if opening == "(":
            caps = JS.known(("head_",), inner) if head else JS.listed(_PAREN, inner)
        elif opening == "[":
            caps = JS.listed(_BRACKET, inner)
        else:
            caps = frozenset(_SEGS)
            for seg in _segments(kinds):
                caps &= JS.known(_SEGS, tuple(seg))
                if not caps:
                    break
            first = next((k for k in kinds if k != "NLS"), "case")
            if first not in ("case", "default"):
                caps -= {"cas_"}
            if ";" not in kinds:
                caps |= JS.listed(_BRACE, tuple(k for k in inner if k != "NLS"))
        if not caps:
            raise Invalid("group")
        names = frozenset(_NAMES.get(c, c[:-1]) for c in caps) | (frozenset(("BR",)) if opening == "{" else frozenset())
        if len(_GROUPS) > MEMORY:
            _GROUPS.clear()
        made = _GROUPS[key] = JS.group(opening, names)
    return made


def _regex_body(body: str, flags: str) -> None:
    """The errors of a pattern that any reader sees: flags, unbalanced groups, a quantifier of nothing."""
    names = _GROUP.findall(re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "a", body))
    if len(names) > len(set(names)):
        raise Invalid("regex")
    if len(set(flags)) < len(flags) or not set(flags) <= set("dgimsuyv") or {"u", "v"} <= set(flags):
        raise Invalid("regex")
    bare = re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "a", body)
    depth = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise Invalid("regex")
    if depth or re.search(r"(?:^|[(|])[*+?](?<!\(\?)", bare) or re.search(r"[*+?]{2}[*+]", bare):
        raise Invalid("regex")


def _in_loop(cur: list[str], heads: tuple[str, ...]) -> bool:
    """Does the statement that comes next, after the kinds read so far, stand right under a head such as ``for (...)``?"""
    i = len(cur) - 1
    while i >= 0:
        k = cur[i]
        if k == "do":
            return True
        if k[0] == "(" and i and (cur[i - 1] in heads or cur[i - 1] in ("AWAIT", "await0")):
            return True
        if k[0] == "(" and i and cur[i - 1] in ("if", "with", "switch"):
            i -= 2
        elif k == ":" and i and cur[i - 1] in ("NAME", "await0", "YIELD"):
            i -= 2
        elif k == "NLS" or k == "try":
            i -= 1
        else:
            # behind an else the head may lie far back; any in this list of statements is taken for it
            return k in ("else", "finally", "catch") or (k[0] == "(" and i > 0 and cur[i - 1] == "catch") if any(h in ("do", *heads) for h in cur[:i]) else False
    return False


class _Reader:
    def __init__(self, text: str):
        self.text, self.pos, self.html = text, 0, False

    def template(self, frame: tuple) -> None:
        """Skip a template literal whose opening has been read."""
        t, n = self.text, len(self.text)
        while self.pos < n:
            c = t[self.pos]
            if c == "\\":
                self.pos += 2
            elif c == "`":
                self.pos += 1
                return
            elif c == "$" and t[self.pos + 1 : self.pos + 2] == "{":
                self.pos += 2
                kinds = self.tokens(frame)
                if not JS.known(("whole",), tuple(kinds)):
                    raise Invalid("template")
            else:
                self.pos += 1
        raise Invalid("template")

    def tokens(self, within: tuple | None = None) -> list[str]:
        """Kinds of the whole text, or (``within`` a function's flags) of a substitution up to its closing brace."""
        text, n = self.text, len(self.text)
        skip, match, punct = _SKIP.match, _TOK.match, _PUNCT.get
        # a frame: opening, outer kinds, (in a function, async, generator, in a loop, in a loop or switch), opening around
        ctx = within or (False, False, False, False, False)
        stack: list[tuple] = []
        cur: list[str] = []
        opening = "{" if within is None else "("
        started = False
        while True:
            m = skip(text, self.pos)
            line = False
            if m:
                gap = m.group()
                line = "\n" in gap or "\r" in gap or "\u2028" in gap or "\u2029" in gap
                self.pos = m.end()
            pos = self.pos
            if text.startswith("<!--", pos) or ((line or not cur and not stack and within is None) and text.startswith("-->", pos)):
                # comments of web pages, which only scripts have
                self.html = True
                self.pos = min(x for x in (n, *(text.find(e, pos) for e in "\n\r\u2028\u2029")) if x >= 0)
                started = line or started
                continue
            line, started = line or started, False
            if pos >= n:
                if stack or within is not None:
                    raise Invalid("end")
                return cur
            prev = cur[-1] if cur else ""
            if text[pos] == "/":
                if text[pos + 1 : pos + 2] == "*":
                    raise Invalid("comment")
                # a slash after a value divides, else it opens a pattern
                value = bool(prev) and _can_end(prev) and prev not in ("return", "return!", "break", "continue", "YIELD", "AWAIT")
                if prev[:1] == "{":
                    value = not line
                elif prev[:1] == "(" and len(cur) > 1 and cur[-2] in ("if", "while", "for", "with"):
                    value = False
                elif prev == "INC":
                    value = len(cur) > 1 and _can_end(cur[-2])
                if prev == "await0":
                    value = False
                if not value:
                    r = _REGEX.match(text, pos)
                    if not r:
                        raise Invalid("regex")
                    _regex_body(*r.groups())
                    self.pos = r.end()
                    if line and opening == "{" and prev and _can_end(prev) and not (prev[0] == "(" and len(cur) > 1 and cur[-2] in _HEADS):
                        cur.append("NLS")
                    cur.append("REGEX")
                    continue
            m = match(text, pos)
            if not m:
                raise Invalid("character")
            i = m.lastindex
            self.pos = m.end()
            w = m.group(i)
            if i == 1:
                if w[0] == "#":
                    k = "PRIV"
                elif prev in (".", "?."):
                    k = "NAME"
                elif w in RESERVED:
                    k = "return!" if w == "return" and not ctx[0] else w
                    if opening == "{" and (w == "break" and not (ctx[4] or _in_loop(cur, ("for", "while", "switch"))) or w == "continue" and not (ctx[3] or _in_loop(cur, ("for", "while")))):
                        k += "!"
                elif w in CONTEXT:
                    k = w
                elif w == "await":
                    k = "AWAIT" if ctx[1] else "await0" if not ctx[0] or "async" in cur or any("async" in f[1] for f in stack) else "NAME"
                elif w == "yield":
                    k = "YIELD" if ctx[2] else "NAME"
                else:
                    k = "NAME"
                    if not w.isascii() and not w.replace("$", "_").replace("\u200c", "").replace("\u200d", "").isidentifier():
                        raise Invalid("character")
            elif i == 2:
                if w in ")]}":
                    if not stack:
                        if within is not None and w == "}":
                            return cur
                        raise Invalid("bracket")
                    if stack[-1][0] != _CLOSE[w]:
                        raise Invalid("bracket")
                    outer = stack[-1][1]
                    made = _close(_CLOSE[w], cur, bool(outer) and (outer[-1] == "for" or outer[-1] in ("AWAIT", "await0") and outer[-2:-1] == ["for"]))
                    _, cur, ctx, opening = stack.pop()
                    if w == "]" and cur and cur[-1] == "let" and opening == "{" and (len(cur) < 2 or cur[-2] in (";", "NLS", "do", "else") or cur[-2][0] in "{(:"):
                        cur[-1] = "let["
                    cur.append(made)
                    continue
                k = "{" if w == "{" else punct(w, w)
            elif i == 3:
                after = text[self.pos : self.pos + 1]
                if after.isalnum() or (after and after in "_$") or (after == "." and _OCTAL.match(w) and text[self.pos + 1 : self.pos + 2].isdigit()):
                    raise Invalid("number")
                k = "NUMBER"
            elif i == 4:
                if "\\" in w and _BAD_ESCAPE.search(_ESCAPED.sub("", w)):
                    raise Invalid("escape")
                k = "STRING"
            else:
                self.template(ctx)
                k = "TPL"
            if line and opening == "{" and prev and _can_start(k) and _can_end(prev):
                after_head = prev[0] == "(" and len(cur) > 1 and (cur[-2] in _HEADS or cur[-2] == "AWAIT")
                body = k == "{" and prev[0] in "(" and k[0] == "{"
                goes_on = prev[0] == "{" and k in _AFTER_BLOCK
                if not after_head and not body and not goes_on:
                    cur.append("NLS")
            if i == 2 and w in "([{":
                inner = ctx
                if w == "{":
                    inner = self.context(cur, ctx)
                stack.append((w, cur, ctx, opening))
                cur, ctx, opening = [], inner, w
                continue
            cur.append(k)

    @staticmethod
    def context(cur: list[str], ctx: tuple) -> tuple:
        """Flags inside a brace: those of a new function if it opens a body, else those around it."""
        loop = ctx[3] or _in_loop(cur, ("for", "while"))
        inner = (*ctx[:3], loop, loop or ctx[4] or _in_loop(cur, ("for", "while", "switch")))
        if not cur:
            return inner
        last = cur[-1]
        if last == "static":
            return (*ctx[:3], False, False)
        if last == "=>":
            at = len(cur) - 3
            return (True, at >= 0 and cur[at] == "async", False, False, False)
        if last[0] == "(" and len(cur) > 1 and cur[-2] not in _HEADS and cur[-2] not in ("AWAIT", "await0"):
            i = len(cur) - 2
            gen = False
            if cur[i] not in ("function", "STAR"):
                i -= 1
            if i >= 0 and cur[i] == "STAR":
                gen, i = True, i - 1
            if i >= 0 and cur[i] == "function":
                i -= 1
            return (True, i >= 0 and cur[i] == "async", gen, False, False)
        return inner


def accepts(text: str) -> bool:
    """Is ``text`` a JavaScript script or module?"""
    try:
        t = text.removeprefix("\ufeff")
        if t.startswith("#!"):
            t = re.sub(r"^#![^\n\r]*", "", t)
        reader = _Reader(t)
        kinds = reader.tokens()
        goal = ("script_",) if reader.html else ("top_",)
        return all(JS.known(goal, tuple(s)) for s in _segments(kinds))
    except Invalid:
        return False
