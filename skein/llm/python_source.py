"""Python 3.13: tokens, bracket groups, logical lines and blocks, recognised by generalised LL."""

from __future__ import annotations

import re
import unicodedata

from .gll import MEMORY, Grammar, Invalid

# fixed values: the language's words and operators
HARD = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = {"match": frozenset(("NAME", "match")), "case": frozenset(("NAME", "case")), "type": frozenset(("NAME", "type")), "_": frozenset(("NAME",))}
_OPS = {"/": "/", "//": "BINOP", "%": "BINOP", "&": "BINOP", "^": "BINOP", "<<": "BINOP", ">>": "BINOP"} | {o: "CMP" for o in ("<", ">", "==", ">=", "<=", "!=")}
_OPS |= {o: "AUG" for o in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=")}

GRAMMAR = r"""
named: NAME := expr | expr
expr: disj | disj if disj else expr | lambda lparams? ':' expr
disj: inv ( boolop inv )*
boolop: and | or
inv: not inv | comp
comp: bin ( cmpop bin )*
cmpop: CMP | in | not in | is | is not
bin: un ( binop un )*
binop: BINOP | / | + | - | '*' | '**' | '|' | @
un: + un | - un | ~ un | await? primary
primary: atom trailer*
trailer: . NAME | args | sub
atom: NAME | NUMBER | STRING | True | False | None | ... | grp | lst | dct | set
starx: '*' bin | expr
starn: '*' bin | named
starxs: starx ( , starx )* ,?
yieldx: yield starxs? | yield from expr
rhs: starxs | yieldx
target: '*' tatom | tatom
tatom: NAME | primary . NAME | primary sub | tgt
targets: target ( , target )* ,?
single: NAME | primary . NAME | primary sub | sgl
dtargets: datom ( , datom )* ,?
datom: NAME | primary . NAME | primary sub | dtgt
dotted: NAME ( . NAME )*
asname: NAME ( as NAME )?
dasname: dotted ( as NAME )?
dots: ( . | ... )
small: ( targets = )+ rhs | single AUG rhs | single ':' expr ( = rhs )? | starxs | yieldx
 | return starxs? | import dasname ( , dasname )* | from dots* dotted import imports | from dots+ import imports
 | raise | raise expr ( from expr )? | pass | break | continue | del dtargets | assert expr ( , expr )?
 | global NAME ( , NAME )* | nonlocal NAME ( , NAME )* | type NAME tps? = expr
imports: '*' | asname ( , asname )* | imp
S: small ( ; small )* ;?
if_h: if named ':'
elif_h: elif named ':'
else_h: else ':'
for_h: async? for targets in starxs ':'
while_h: while named ':'
try_h: try ':'
exc_h: except ':' | except expr ( as NAME )? ':'
excs_h: except '*' expr ( as NAME )? ':'
fin_h: finally ':'
withitem: expr ( as target )?
with_h: async? with withitem ( , withitem )* ':' | async? with withs ':'
def_h: async? def NAME tps? params ( -> expr )? ':'
class_h: class NAME tps? args? ':'
subject: starn , ( starn ( , starn )* ,? )? | named
match_h: match subject ':'
case_h: case patterns ( if named )? ':'
deco: @ named
if_i: if_h S
elif_i: elif_h S
else_i: else_h S
for_i: for_h S
while_i: while_h S
try_i: try_h S
exc_i: exc_h S
excs_i: excs_h S
fin_i: fin_h S
with_i: with_h S
def_i: def_h S
class_i: class_h S
case_i: case_h S
patterns: mstar , ( mstar ( , mstar )* ,? )? | pattern
mstar: '*' NAME | pattern
pattern: closed ( '|' closed )* ( as NAME )?
closed: -? NUMBER | -? NUMBER + NUMBER | -? NUMBER - NUMBER | STRING | None | True | False | dotted | dotted patargs | patp | patl | patm
compfor: ( async? for targets in disj ( if disj )* )+
args_: | arglist ,? | named compfor
pos: '*' expr | named
kw1: NAME = expr | '*' expr
kw2: NAME = expr | '**' expr
kws: kw1 ( , kw1 )* | kw1 ( , kw1 )* , kw2 ( , kw2 )* | kw2 ( , kw2 )*
arglist: pos ( , pos )* | pos ( , pos )* , kws | kws
grp_: | yieldx | named | starn , ( starn ( , starn )* ,? )? | named compfor
lst_: | starn ( , starn )* ,? | named compfor
set_: starn ( , starn )* ,? | named compfor
dict1: expr ':' expr | '**' bin
dct_: | dict1 ( , dict1 )* ,? | expr ':' expr compfor
slice: expr? ':' expr? ( ':' expr? )? | named | '*' bin
sub_: slice ( , slice )* ,?
param: NAME ( ':' expr )?
dparam: param = expr
vparam: NAME ( ':' starx )?
kparam: param | dparam
tail: '*' vparam ( , kparam )* ( , '**' param )? | '*' ( , kparam )+ ( , '**' param )? | '**' param
npart: param ( , param )* | param ( , param )* , / | param ( , param )* , / ( , param )+
dpart: dparam ( , dparam )* | dparam ( , dparam )* , / ( , dparam )*
prest: dpart | dpart , tail | tail
ndpart: param ( , param )* , dpart
params_: | npart ,? | npart , prest ,? | prest ,?
lkparam: NAME | NAME = expr
ltail: '*' NAME ( , lkparam )* ( , '**' NAME )? | '*' ( , lkparam )+ ( , '**' NAME )? | '**' NAME
lnpart: NAME ( , NAME )* | NAME ( , NAME )* , / | NAME ( , NAME )* , / ( , NAME )+
ldef: NAME = expr
ldpart: ldef ( , ldef )* | ldef ( , ldef )* , / ( , ldef )*
lrest: ldpart | ldpart , ltail | ltail
lparams: lnpart ,? | lnpart , lrest ,? | lrest ,?
imp_: asname ( , asname )* ,?
withs_: withitem ( , withitem )* ,?
tgt_: | targets
sgl_: single
dtgt_: | dtargets
tp: NAME ( ':' expr )? ( = expr )? | '*' NAME ( = starx )? | '**' NAME ( = expr )?
tps_: tp ( , tp )* ,?
patp_: | pattern | mstar , ( mstar ( , mstar )* ,? )?
patl_: | mstar ( , mstar )* ,?
pkey: -? NUMBER | -? NUMBER + NUMBER | -? NUMBER - NUMBER | STRING | None | True | False | NAME ( . NAME )+
pitem: pkey ':' pattern | '**' NAME
patm_: | pitem ( , pitem )* ,?
parg: NAME = pattern
patargs_: | pattern ( , pattern )* ,? | pattern ( , pattern )* ( , parg )+ ,? | parg ( , parg )* ,?
fx: rhs =? conv? | rhs =? conv? ':'
conv: ! NAME
stmt: S | if_ elifs* else_? | for_ else_? | while_ else_? | try_ exc_+ else_? fin_? | try_ excs_+ else_? fin_? | try_ fin_ | with_ | deco* def_ | deco* class_ | match_h CASES
if_: if_h BLK | if_i
elifs: elif_h BLK | elif_i
else_: else_h BLK | else_i
for_: for_h BLK | for_i
while_: while_h BLK | while_i
try_: try_h BLK | try_i
exc_: exc_h BLK | exc_i
excs_: excs_h BLK | excs_i
fin_: fin_h BLK | fin_i
with_: with_h BLK | with_i
def_: def_h BLK | def_i
class_: class_h BLK | class_i
case_: case_h BLK | case_i
"""

# statements are recognised over line classes: there the names of line classes are terminals
_LINES = ["S", "deco", *(f"{x}_{y}" for x in "if elif else for while try exc excs fin with def class case".split() for y in "hi"), "match_h"]
_SOURCE, _BLOCKS = GRAMMAR[: GRAMMAR.index("stmt:")], GRAMMAR[GRAMMAR.index("stmt:") :]
_INNER = {"(": ("args_", "grp_", "imp_", "withs_", "tgt_", "sgl_", "dtgt_", "patp_", "patargs_"), "[": ("lst_", "sub_", "tps_", "patl_", "tgt_", "dtgt_"), "{": ("dct_", "set_", "patm_")}
_CLOSE = {")": "(", "]": "[", "}": "{"}

_TOK = re.compile(
    r"""[ \t\f]*(?:([^\W\d]\w*+)(?!["'])|(\.\.\.|\*\*=?|//=?|>>=?|<<=?|->|:=|[-+*/%@&|^<>=!]=|[-+*/%@&|^~<>=,:;()\[\]{}!]|\.(?!\d))|(\r\n|\n|\r)|((?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?))|((?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"|\'\'\'|"|\'))|(\#[^\r\n]*)|(\\(?:\r\n|\n|\r))|([^\W\d]\w*)|(\Z))"""
)
_KIND = {w: w for w in (*HARD, *SOFT)}
_ENDS = {
    "'": re.compile(r"[^'\\\r\n]*(?:\\(?:\r\n|[\s\S])[^'\\\r\n]*)*'"),
    '"': re.compile(r'[^"\\\r\n]*(?:\\(?:\r\n|[\s\S])[^"\\\r\n]*)*"'),
    "'''": re.compile(r"[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''"),
    '"""': re.compile(r'[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""'),
}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{0,2})|u([0-9a-fA-F]{0,4})|U([0-9a-fA-F]{0,8})|N(\{[^}]*\})?|[\s\S])")
_LEAD = re.compile(r"[ \t\f]*")
_OLD = re.compile(r"0[0-9_]*[1-9]$|00*[1-9][0-9_]*$")
_AFTER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")

_ITEMS = ("pos", "kw1", "kw2", "starn", "named", "dict1", "slice", "mstar", "pattern", "pitem", "parg", "datom", "target", "asname", "withitem", "tp")
#: Words behind which a comma may belong to an item.
_COMMAS = ("lambda", "for", "yield")
PY = Grammar(_SOURCE, SOFT, _ITEMS)
_GROUPS: dict[tuple, str] = {}
BLOCKS = Grammar(_BLOCKS)


def _escapes(body: str, is_bytes: bool) -> None:
    if "\\" not in body:
        return
    for m in _ESCAPE.finditer(body):
        x, u, w, name = m.groups()
        if x is not None and len(x) < 2:
            raise Invalid("escape")
        if is_bytes:
            continue
        if (u is not None and len(u) < 4) or (w is not None and (len(w) < 8 or int(w, 16) > 0x10FFFF)):
            raise Invalid("escape")
        if m.group()[1] == "N":
            try:
                unicodedata.lookup((name or "{}")[1:-1])
            except KeyError:
                raise Invalid("escape") from None


class _Reader:
    def __init__(self, text: str):
        self.text, self.pos = text, 0

    def string(self, opening: str) -> bool:
        """Skip a string whose opening has been read; is it of bytes?"""
        q = opening.lstrip("rRbBuUfF")
        prefix = opening[: len(opening) - len(q)].lower()
        if "f" in prefix:
            self.fstring(q, "r" in prefix)
            return False
        m = _ENDS[q].match(self.text, self.pos)
        if not m:
            raise Invalid("string")
        body = self.text[self.pos : m.end() - len(q)]
        self.pos = m.end()
        if "b" in prefix and not body.isascii():
            raise Invalid("bytes")
        if "r" not in prefix:
            _escapes(body, "b" in prefix)
        return "b" in prefix

    def fstring(self, q: str, raw: bool) -> None:
        t, n = self.text, len(self.text)
        part = self.pos
        while self.pos < n:
            c = t[self.pos]
            if c == "\\":
                # of raw strings a backslash before a brace is itself
                self.pos += 1 if t[self.pos + 1 : self.pos + 2] in ("{", "}") else 2
                if not raw and t[self.pos - 2 : self.pos] == "\\N" and t[self.pos : self.pos + 1] == "{":
                    end = t.find("}", self.pos)
                    if end < 0:
                        raise Invalid("escape")
                    self.pos = end + 1
            elif t.startswith(q, self.pos):
                if not raw:
                    _escapes(re.sub(r"\{[^}]*$", "", t[part : self.pos]), False)
                self.pos += len(q)
                return
            elif c in "\r\n" and len(q) == 1:
                raise Invalid("string")
            elif c == "{":
                if t.startswith("{{", self.pos):
                    self.pos += 2
                    continue
                self.pos += 1
                self.field(q, raw, 0)
                part = self.pos
            elif c == "}":
                if not t.startswith("}}", self.pos):
                    raise Invalid("brace")
                self.pos += 2
            else:
                self.pos += 1
        raise Invalid("string")

    def field(self, q: str, raw: bool, deep: int) -> None:
        """A replacement field, the opening brace having been read."""
        kinds = self.tokens(field=True)
        if not PY.known(("fx",), kinds):
            raise Invalid("field")
        t = self.text
        if kinds and kinds[-1] == ":":
            while True:
                c = t[self.pos : self.pos + 1]
                if not c or (c in "\r\n" and len(q) == 1) or t.startswith(q, self.pos):
                    raise Invalid("field")
                self.pos += 1
                if c == "{":
                    if deep > 1:
                        raise Invalid("field")
                    self.field(q, raw, deep + 1)
                elif c == "}":
                    return
                elif c == "\\":
                    self.pos += 1

    def tokens(self, field: bool = False):
        """The kinds of a replacement field up to its end, or the lines of the whole text."""
        text, match, kind, ops, groups = self.text, _TOK.match, _KIND.get, _OPS.get, _GROUPS
        stack: list[tuple[str, list]] = []
        cur: list[str] = []
        lines: list[tuple[int, int, tuple]] = []
        n = len(text)
        strings = -1  # kind of the string literal that the current token follows: 1 bytes, 0 text
        indent = (0, 0)
        fresh = not field
        while True:
            pos = self.pos
            if fresh:
                fresh = False
                lead = _LEAD.match(text, pos)
                pos = lead.end()
                blank = lead.group()
                if "\t" in blank or "\f" in blank:
                    blank = blank[blank.rfind("\f") + 1 :]
                    col, alt = len(blank.expandtabs(8)), len(blank)
                else:
                    col = alt = len(blank)
                indent = (col, alt)
                self.pos = pos
            if pos >= n:
                if field or stack:
                    raise Invalid("end")
                if cur:
                    lines.append((*indent, tuple(cur)))
                return lines
            m = match(text, pos)
            if not m:
                raise Invalid("character")
            i = m.lastindex
            self.pos = m.end()
            if i == 1 or i == 8:
                w = m.group(i)
                strings = -1
                cur.append(kind(w, "NAME"))
                if not w.isascii() and not w.isidentifier():
                    raise Invalid("character")
            elif i == 2:
                op = m.group(2)
                strings = -1
                if op in "([{":
                    stack.append((op, cur))
                    cur = []
                elif op in ")]}":
                    if field and not stack:
                        if op != "}":
                            raise Invalid("bracket")
                        return tuple(cur)
                    if not stack or stack[-1][0] != _CLOSE[op]:
                        raise Invalid("bracket")
                    opening, outer = stack.pop()
                    inner = tuple(cur)
                    key = (opening, inner)
                    made = groups.get(key)
                    if made is None:
                        whole = any(w in inner for w in _COMMAS)
                        caps = (PY.known if whole else PY.listed)(_INNER[opening], inner)
                        if opening == "(":
                            caps |= PY.known(("params_",), inner)
                        if not caps:
                            raise Invalid("group")
                        if len(groups) > MEMORY:
                            groups.clear()
                        made = groups[key] = PY.group(opening, frozenset(c[:-1] for c in caps))
                    outer.append(made)
                    cur = outer
                elif field and not stack and op in (":", ":="):
                    cur.append(":")
                    self.pos = m.start(2) + 1
                    return tuple(cur)
                elif op == "!":
                    if not field or stack:
                        raise Invalid("character")
                    cur.append("!")
                elif op == "!=" and field and not stack and text[self.pos : self.pos + 1] in ("}", ":"):
                    raise Invalid("field")
                else:
                    cur.append(ops(op, op))
            elif i == 3:
                if stack or field:
                    continue
                strings = -1
                if cur:
                    lines.append((*indent, tuple(cur)))
                    cur = []
                fresh = True
            elif i == 4:
                num = m.group(4)
                strings = -1
                after = text[self.pos : self.pos + 1]
                if (after.isalnum() or after == "_") and not _AFTER.match(text, self.pos):
                    raise Invalid("number")
                if num[0] == "0" and _OLD.match(num) and num.replace("_", "").isdigit():
                    raise Invalid("number")
                cur.append("NUMBER")
            elif i == 5:
                b = self.string(m.group(5))
                if strings >= 0:
                    if strings != b:
                        raise Invalid("strings")
                else:
                    cur.append("STRING")
                strings = int(b)
            elif i == 7 and self.pos >= n:
                raise Invalid("end")


_STARTS = tuple(_LINES)
_GO_ON = frozenset(x for y in ("elif", "else", "exc", "excs", "fin") for x in (f"{y}_h", f"{y}_i"))


def _block(parts: list[str]) -> frozenset:
    """What a block of line classes and inner blocks may be: statements, or cases."""
    chunk: list[str] = []
    caps = {"BLK", "CASES"}

    def end() -> None:
        got = BLOCKS.known(("stmt", "case_"), tuple(chunk))
        if "stmt" not in got:
            caps.discard("BLK")
        if "case_" not in got:
            caps.discard("CASES")

    for p in parts:
        terms = BLOCKS.terminals(p)
        inner = p[0] == "B"
        if chunk and not inner and terms.isdisjoint(_GO_ON) and "deco" not in BLOCKS.terminals(chunk[-1]):
            end()
            chunk = []
        chunk.append(p)
    if chunk:
        end()
    return frozenset(caps)


def accepts(text: str) -> bool:
    """Is ``text`` a Python 3.13 module?"""
    try:
        if "\0" in text:
            raise Invalid("null")
        lines = _Reader(text.removeprefix("\ufeff")).tokens()
        levels = [(0, 0)]
        open_: list[list[str]] = [[]]
        for col, alt, kinds in lines:
            top = levels[-1]
            if col > top[0]:
                if alt <= top[1] or not open_[-1]:
                    raise Invalid("indent")
                levels.append((col, alt))
                open_.append([])
            else:
                while col < levels[-1][0]:
                    levels.pop()
                    caps = _block(open_.pop())
                    if not caps:
                        raise Invalid("block")
                    open_[-1].append(BLOCKS.group("B", caps))
                if (col, alt) != levels[-1]:
                    raise Invalid("indent")
            cls = PY.known(_STARTS, kinds)
            if not cls:
                raise Invalid("line")
            open_[-1].append(BLOCKS.group("L", cls))
        while len(open_) > 1:
            caps = _block(open_.pop())
            if not caps:
                raise Invalid("block")
            open_[-1].append(BLOCKS.group("B", caps))
        return not open_[0] or "BLK" in _block(open_[0])
    except Invalid:
        return False
