"""A generalised LL recogniser with a graph-structured stack, and content-keyed memory of what it recognised.

Grammars are given as EBNF text. All start symbols asked for run together over one stack: a stack node is a
nonterminal at a position, its edges say where to return, and what a node has matched is kept for edges that come
later. So left recursion and ambiguity need no rewriting, and dialects share whatever they have in common.

A ``Reader`` of a language turns a text into nested groups (brackets, blocks) from the inside out. A group's content
is recognised once per sequence of token kinds, for all the nonterminals a group of that bracket may be, and stands
in its surroundings as one token that is a terminal of each of them.
"""

from __future__ import annotations

import re

#: Sequences remembered per grammar, and token kinds in them, before the memory is emptied.
MEMORY, MEMORY_KINDS = 200_000, 20_000_000
#: Equal neighbours in a list that are read; more cannot change the verdict (see ``Grammar.listed``).
RUN = 16


class Grammar:
    """``items`` are nonterminals that stand between the commas of lists and derive no comma themselves."""

    def __init__(self, text: str, classes: dict[str, frozenset] | None = None, items: tuple[str, ...] = ()):
        self.items = items
        self.classes = dict(classes or {})
        self.rules: dict[str, list[tuple]] = {}
        self._n = 0
        raw: dict[str, str] = {}
        for line in re.sub(r"\n\s+\|", " |", text.strip()).splitlines():
            if line.strip() and not line.startswith("#"):
                name, body = line.split(":", 1)
                raw[name.strip()] = raw[name.strip()] + " | " + body if name.strip() in raw else body
        self.names = set(raw)
        for name, body in raw.items():
            toks = re.findall(r"'[^']+'[?*+]?|[()|]|\)[?*+]|!?[^\s()|]+", re.sub(r"\)([?*+])", r") \1", body))
            self._i, self._t = 0, toks
            self.rules[name] = self._alts()
        for v in items:
            self.rules[v].append(((0, f"<{v}>"),))
        self._first()
        self._choice: dict[tuple, list] = {}
        self.memory: dict[tuple, frozenset] = {}
        self.held = 0
        self._held_items: dict[tuple, tuple] = {}

    def _new(self, alts: list[tuple]) -> tuple:
        self._n += 1
        name = f"%{self._n}"
        self.rules[name] = alts
        return (1, name)

    def _alts(self) -> list[tuple]:
        alts, seq = [], []
        while self._i < len(self._t):
            t = self._t[self._i]
            if t == ")":
                break
            self._i += 1
            if t == "|":
                alts.append(tuple(seq))
                seq = []
                continue
            if t == "(":
                sym = self._new(self._alts())
                self._i += 1
                mark = self._t[self._i] if self._i < len(self._t) and self._t[self._i] in ("?", "*", "+") else ""
                self._i += bool(mark)
            else:
                quoted = t[0] == "'"
                mark = t[-1] if t[-1] in "?*+" and (len(t) > 1 and (not quoted or t[-2] == "'")) else ""
                t = t[: len(t) - len(mark)]
                neg = t[0] == "!" and len(t) > 1
                t = t[neg:].strip("'")
                sym = (2, t) if neg else (1, t) if not quoted and t in self.names else (0, t)
            if mark == "?":
                sym = self._new([(sym,), ()])
            elif mark in ("*", "+"):
                # left recursion: one node of the stack serves all repetitions
                loop = self._new([])
                self.rules[loop[1]] += [() if mark == "*" else (sym,), (loop, sym)]
                sym = loop
            seq.append(sym)
        alts.append(tuple(seq))
        return alts

    def _first(self) -> None:
        first = {n: set() for n in self.rules}
        null: set[str] = set()
        grew = True
        while grew:
            grew = False
            for n, alts in self.rules.items():
                for alt in alts:
                    f, e = self._of(alt, first, null)
                    if not f <= first[n] or (e and n not in null):
                        first[n] |= f
                        if e:
                            null.add(n)
                        grew = True
        self.table = {n: [(alt, *self._of(alt, first, null)) for alt in alts] for n, alts in self.rules.items()}

    @staticmethod
    def _of(alt: tuple, first: dict, null: set) -> tuple[set, bool]:
        f: set = set()
        for k, v in alt:
            if k == 2:
                continue
            if k == 0:
                return f | {v}, False
            f |= first[v]
            if v not in null:
                return f, False
        return f, True

    def terminals(self, kind: str) -> frozenset:
        c = self.classes.get(kind)
        if c is None:
            c = self.classes[kind] = frozenset((kind,))
        return c

    def accepts(self, starts: tuple[str, ...], kinds: tuple[str, ...]) -> frozenset:
        """Those start symbols that derive the whole sequence of token kinds."""
        n = len(kinds)
        ks = (*kinds, "%end")
        cls = [self.terminals(k) for k in kinds] + [frozenset()]
        nodes: dict[tuple, list] = {}
        work: list[tuple] = []
        seen: set[tuple] = set()
        choice, table = self._choice, self.table

        def enter(name: str, pos: int) -> list:
            node = nodes[(name, pos)] = [[], set(), set()]
            key = (name, ks[pos])
            alts = choice.get(key)
            if alts is None:
                here = cls[pos]
                alts = choice[key] = [alt for alt, f, e in table[name] if e or not f.isdisjoint(here)]
            for alt in alts:
                work.append((alt, 0, node, pos))
            return node

        for s in starts:
            if (s, 0) not in nodes:
                enter(s, 0)
        while work:
            alt, dot, node, pos = work.pop()
            while True:
                if dot == len(alt):
                    if pos not in node[1]:
                        node[1].add(pos)
                        for ralt, rdot, rnode in node[0]:
                            d = (id(ralt), rdot, id(rnode), pos)
                            if d not in seen:
                                seen.add(d)
                                work.append((ralt, rdot, rnode, pos))
                    break
                k, v = alt[dot]
                if k == 0:
                    if v not in cls[pos]:
                        break
                    pos += 1
                    dot += 1
                    continue
                if k == 2:
                    if v in cls[pos]:
                        break
                    dot += 1
                    continue
                child = nodes.get((v, pos)) or enter(v, pos)
                edge = (id(alt), dot + 1, id(node))
                if edge not in child[2]:
                    child[2].add(edge)
                    child[0].append((alt, dot + 1, node))
                    for p in child[1]:
                        d = (id(alt), dot + 1, id(node), p)
                        if d not in seen:
                            seen.add(d)
                            work.append((alt, dot + 1, node, p))
                break
        return frozenset(s for s in starts if n in nodes[(s, 0)][1])

    def known(self, starts: tuple[str, ...], kinds: tuple[str, ...]) -> frozenset:
        """``accepts``, remembered by content."""
        key = (starts, kinds)
        got = self.memory.get(key)
        if got is None:
            self.held += len(kinds)
            if len(self.memory) > MEMORY or self.held > MEMORY_KINDS:
                self.memory.clear()
                self.held = len(kinds)
            got = self.memory[key] = self.accepts(starts, kinds)
        return got

    def _items_of(self, starts: tuple[str, ...]) -> tuple[str, ...]:
        """The items that lists of ``starts`` may hold."""
        found = self._held_items.get(starts)
        if found is None:
            reached, todo = set(starts), list(starts)
            while todo:
                name = todo.pop()
                new = set() if name in self.items else {v for alt in self.rules[name] for k, v in alt if k == 1} - reached
                reached |= new
                todo += new
            found = self._held_items[starts] = tuple(i for i in self.items if i in reached)
        return found

    def listed(self, starts: tuple[str, ...], kinds: tuple[str, ...]) -> frozenset:
        """``known`` for contents in which every comma parts two items of a list.

        Each distinct item is recognised once and stands in the list as one token, a terminal of each of ``items`` it
        derives. As no item derives a comma, the list is derived from those exactly where it is from the whole text.

        Of a run of equal items ``RUN`` are kept. Every repetition of the list rules takes one item a round, and no
        rule names as many as ``RUN`` items outside of repetitions; so any derivation of a run that long goes round
        one of them, and a round more or less is a derivation too: longer runs have the verdict of ``RUN``.
        """
        if "," not in kinds:
            return self.known(starts, kinds)
        items = self._items_of(starts)
        out: list[str] = []
        at, last, run = 0, "", 0
        while True:
            try:
                end = kinds.index(",", at)
            except ValueError:
                end = len(kinds)
            if end > at:
                caps = self.known(items, kinds[at:end])
                if not caps:
                    return frozenset()
                item = self.group("<", frozenset(f"<{c}>" for c in caps))
                run = run + 1 if item == last else 1
                last = item
                if run > RUN:
                    out.pop()
                else:
                    out.append(item)
            else:
                run = 0
            if end == len(kinds):
                return self.known(starts, tuple(out))
            out.append(",")
            at = end + 1

    def group(self, mark: str, caps: frozenset) -> str:
        """The kind of a token that is a terminal of each of ``caps``."""
        kind = mark + "+".join(sorted(caps))
        if kind not in self.classes:
            self.classes[kind] = caps
        return kind


class Invalid(Exception):
    """The text is rejected by every dialect."""
