"""Table-driven generalised LR recognition over interned stacks.

A grammar in extended BNF becomes LR(0) states with SLR(1) lookaheads; conflicts stay in the table and
fork the stack. Stacks are interned: equal stacks are one node, so forks that agree again are one, and
what a set of stacks becomes after a whole line of token classes is a single lookup once it was seen.
"""

from __future__ import annotations

import re
from itertools import product

_EBNF = re.compile(r"'[^']+'|\w+|[()|?*+]")


class Grammar:
    """Productions from rules 'name: alternatives'; quoted (quotes kept) and upper-case symbols are terminals. No rule may derive nothing."""

    def __init__(self, text: str, start: str):
        self.rules: dict[str, set[tuple[str, ...]]] = {}
        self.memo: dict[tuple, str] = {}
        for chunk in re.split(r"\n(?=\w+:)", text.strip()):
            name, _, body = chunk.partition(":")
            tokens = _EBNF.findall(body)
            alternatives, at = self._alternatives(tokens, 0)
            assert at == len(tokens), (name, tokens[at:])
            self.rules.setdefault(name.strip(), set()).update(alternatives)
        for name, alternatives in self.rules.items():
            assert () not in alternatives, f"{name} may be empty"
        self.start = start
        for alternatives in self.rules.values():
            for a in alternatives:
                for s in a:
                    assert s in self.rules or not s[0].islower(), f"unknown {s}"

    def _alternatives(self, tokens: list[str], at: int) -> tuple[list[tuple[str, ...]], int]:
        out: list[tuple[str, ...]] = []
        while True:
            parts: list[list[tuple[str, ...]]] = []
            while at < len(tokens) and tokens[at] not in ("|", ")"):
                if tokens[at] == "(":
                    inner, at = self._alternatives(tokens, at + 1)
                    at += 1
                    part = inner
                else:
                    part, at = [(tokens[at],)], at + 1
                while at < len(tokens) and tokens[at] in "?*+":
                    if tokens[at] == "?":
                        part = [(), *part]
                    else:
                        part = ([()] if tokens[at] == "*" else []) + [(self._list(tuple(part)),)]
                    at += 1
                parts.append(part if len(part) < 4 or () in part else [(self._group(tuple(part)),)])
            out += [sum(combination, ()) for combination in product(*parts)]
            if at < len(tokens) and tokens[at] == "|":
                at += 1
                continue
            return out, at

    def _group(self, part: tuple) -> str:
        if ("g", part) not in self.memo:
            name = self.memo["g", part] = f"_group{len(self.memo)}"
            self.rules[name] = set(part)
        return self.memo["g", part]

    def _list(self, part: tuple) -> str:
        if ("l", part) not in self.memo:
            name = self.memo["l", part] = f"_list{len(self.memo)}"
            self.rules[name] = {p for p in part} | {(name, *p) for p in part}
        return self.memo["l", part]

    def tables(self) -> tuple[list[dict], list[dict]]:
        """action: per state, terminal -> (state shifted to or -1, reductions (left side, length)); goto: per state, rule -> state."""
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        follow: dict[str, set[str]] = {n: set() for n in self.rules}
        firsts = lambda s: first[s] if s in self.rules else {s}
        changed = True
        while changed:
            changed = False
            for n, alternatives in self.rules.items():
                for a in alternatives:
                    new = firsts(a[0]) - first[n]
                    if new:
                        first[n] |= new
                        changed = True
        changed = True
        while changed:
            changed = False
            for n, alternatives in self.rules.items():
                for a in alternatives:
                    for k, s in enumerate(a):
                        if s in self.rules:
                            new = (firsts(a[k + 1]) if k + 1 < len(a) else follow[n]) - follow[s]
                            if new:
                                follow[s] |= new
                                changed = True
        numbered = [("_start", (self.start,))] + [(n, a) for n in sorted(self.rules) for a in sorted(self.rules[n])]
        by_left: dict[str, list[int]] = {}
        for k, (n, _) in enumerate(numbered):
            by_left.setdefault(n, []).append(k)

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            items, seen = list(kernel), set()
            for k, dot in items:
                right = numbered[k][1]
                if dot < len(right) and (s := right[dot]) in self.rules and s not in seen:
                    seen.add(s)
                    items += [(j, 0) for j in by_left[s]]
            return items

        states = {frozenset([(0, 0)]): 0}
        todo, action, goto = [frozenset([(0, 0)])], [], []
        for kernel in todo:
            moves: dict[str, set] = {}
            reductions: dict[str, list[tuple[str, int]]] = {}
            for k, dot in dict.fromkeys(closure(kernel)):
                n, right = numbered[k]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((k, dot + 1))
                elif k:
                    for t in follow[n]:
                        reductions.setdefault(t, []).append((n, len(right)))
            here, there = {}, {}
            for s, items in moves.items():
                target = frozenset(items)
                if target not in states:
                    states[target] = len(states)
                    todo.append(target)
                (there if s in self.rules else here)[s] = states[target]
            action.append({t: (here.get(t, -1), tuple(reductions.get(t, ()))) for t in here.keys() | reductions.keys()})
            goto.append(there)
        return action, goto


class Recogniser:
    """Feeds lines of token classes (one character each) to sets of interned stacks."""

    NODES, LINES = 3_000_000, 1_500_000  # interned stacks and known lines after which both start anew

    def __init__(self, grammar: Grammar, classes: dict[str, str], inserted: str = "", before: str = "", restricted: str = ""):
        """classes: terminal -> character. inserted: the class put in where a line can't go on, or before a class in before; restricted: classes that never go on from the line above."""
        action, goto = grammar.tables()
        self.action = [{classes[t]: v for t, v in a.items() if t in classes} for a in action]
        self.goto = goto
        self.inserted, self.before, self.restricted = inserted, before, restricted
        self.clear()

    def clear(self) -> None:
        self.state, self.parent = [0], [-1]
        self.nodes: dict[tuple[int, int], int] = {}
        self.sets: dict[tuple[int, ...], int] = {(): 0, (0,): 1}
        self.members: list[tuple[int, ...]] = [(), (0,)]
        self.lines: dict[tuple[int, str], int] = {}

    def _node(self, parent: int, state: int) -> int:
        if (n := self.nodes.get((parent, state))) is None:
            n = self.nodes[parent, state] = len(self.state)
            self.state.append(state)
            self.parent.append(parent)
        return n

    def _shift(self, tops: tuple[int, ...], c: str) -> tuple[int, ...]:
        out, work = set(), list(tops)
        seen = set(work)
        state, parent = self.state, self.parent
        while work:
            n = work.pop()
            if (found := self.action[state[n]].get(c)) is None:
                continue
            to, reductions = found
            if to >= 0:
                out.add(self._node(n, to))
            for left, length in reductions:
                m = n
                for _ in range(length):
                    m = parent[m]
                x = self._node(m, self.goto[state[m]][left])
                if x not in seen:
                    seen.add(x)
                    work.append(x)
        return tuple(sorted(out))

    def line(self, at: int, classes: str, fresh: bool = True) -> int:
        """The set after a line, 0 where nothing accepts it; at: the set before. fresh: a line break stands before it."""
        key = (at, classes if fresh else "\0" + classes)
        if (known := self.lines.get(key)) is not None:
            return known
        tops = self.members[at]
        for k, c in enumerate(classes):
            new = self._shift(tops, c)
            if self.inserted and (c in self.before or k == 0 and fresh) and (not new or c in self.restricted):
                new = tuple(sorted({*new, *self._shift(self._shift(tops, self.inserted), c)}))
            tops = new
            if not tops:
                break
        if (number := self.sets.get(tops)) is None:
            number = self.sets[tops] = len(self.members)
            self.members.append(tops)
        self.lines[key] = number
        return number

    def full(self) -> bool:
        return len(self.state) > self.NODES or len(self.lines) > self.LINES
