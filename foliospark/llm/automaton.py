"""Combined deterministic automaton over bytes for a set of regular expressions.

The expressions (literals, classes, groups, ``|``, ``? * +``, ``{m}`` ``{m,}`` ``{m,n}``) become
one nondeterministic automaton whose start is kept alive at every byte, so that one pass finds
the matches of all rules wherever they begin. Subset construction over byte classes makes it
deterministic, partition refinement makes it minimal, and arrays hold the transitions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1


_SETS = {
    "d": frozenset(range(48, 58)),
    "w": frozenset([*range(48, 58), *range(65, 91), *range(97, 123), 95]),
    "s": frozenset([32, *range(9, 14)]),
}
_ESCAPES = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11}


class _Parser:
    """Recursive descent from a pattern to a syntax tree of tuples."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        tree = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            atom = self.atom()
            while self.peek() and self.peek() in "?*+{":
                low, high = self.count()
                atom = ("times", atom, low, high)
            parts.append(atom)
        return ("then", parts)

    def count(self) -> tuple[int, int | None]:
        c = self.p[self.i]
        self.i += 1
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i : end].partition(",")
        self.i = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 3 if self.p.startswith("(?:", self.i) else 1
            tree = self.either()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            return ("byte", self.folded(self.members()))
        if c in "*+?{^$":
            raise ValueError(f"{c!r} at {self.i} in {self.p!r} is not supported")
        self.i += 1
        if c == ".":
            return ("byte", frozenset(range(256)) - {10})
        if c == "\\":
            return ("byte", self.folded(self.escape()))
        return ("then", [("byte", self.folded(frozenset([b]))) for b in c.encode()])

    def folded(self, members: frozenset[int]) -> frozenset[int]:
        if not self.fold:
            return members
        swap = {b ^ 32 for b in members if chr(b & ~32).isupper() and b < 128}
        return members | swap

    def escape(self) -> frozenset[int]:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return _SETS.get(c) or frozenset([_ESCAPES.get(c, ord(c))])

    def members(self) -> frozenset[int]:
        self.i += 1
        negate = self.peek() == "^"
        self.i += negate
        found: set[int] = set()
        begun = self.i
        while self.peek() != "]" or self.i == begun:
            low = self.one()
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", "") and len(low) == 1:
                self.i += 1
                high = self.one()
                low = frozenset(range(min(low), max(high) + 1))
            found |= low
        self.i += 1
        return frozenset(range(256)) - found if negate else frozenset(found)

    def one(self) -> frozenset[int]:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            return self.escape()
        if ord(c) > 127:
            raise ValueError("classes hold ASCII only")
        return frozenset([ord(c)])


def _build(nfa: _Nfa, tree, at: int) -> int:
    """Adds ``tree`` to the automaton after state ``at``; the state in which it ends."""
    kind = tree[0]
    if kind == "byte":
        end = nfa.state()
        nfa.step[at] = (tree[1], end)
        fresh = nfa.state()
        nfa.empty[end].append(fresh)
        return fresh
    if kind == "then":
        for part in tree[1]:
            at = _build(nfa, part, at)
        return at
    if kind == "or":
        end = nfa.state()
        for part in tree[1]:
            begin = nfa.state()
            nfa.empty[at].append(begin)
            nfa.empty[_build(nfa, part, begin)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        at = _build(nfa, part, at)
    end = nfa.state()
    if high is None:
        loop = nfa.state()
        nfa.empty[at] += [loop, end]
        begin = nfa.state()
        nfa.empty[loop].append(begin)
        nfa.empty[_build(nfa, part, begin)] += [loop, end]
        return end
    for _ in range(high - low):
        begin = nfa.state()
        nfa.empty[at] += [begin, end]
        at = _build(nfa, part, begin)
    nfa.empty[at].append(end)
    return end


class Automaton(NamedTuple):
    """``table[state, klass[byte]]`` is the next state; bit r of ``accepts[state]``: rule r ends here.
    State 0 is the start, in which no rule has begun."""

    klass: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    dead: int


def _closure(nfa: _Nfa, states) -> frozenset[int]:
    todo, seen = list(states), set(states)
    while todo:
        for x in nfa.empty[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return frozenset(seen)


def _mirrored(tree):
    """The syntax tree of the same strings, last byte first."""
    kind = tree[0]
    if kind == "byte":
        return tree
    if kind == "times":
        return ("times", _mirrored(tree[1]), tree[2], tree[3])
    parts = [_mirrored(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "then" else parts)


def compile_rules(patterns: list[tuple[str, bool]], anchored: bool = False, backward: bool = False) -> Automaton:
    """``patterns``: (expression, whether letters match in either case). Unless ``anchored``, a
    match may begin at every byte. ``backward``: the automaton reads a text from its end, and so
    accepts at the bytes where matches begin."""
    nfa, begins, ends = _Nfa(), [], {}
    for r, (pattern, fold) in enumerate(patterns):
        begin = nfa.state()
        begins.append(begin)
        tree = _Parser(pattern, fold).parse()
        ends.setdefault(_build(nfa, _mirrored(tree) if backward else tree, begin), 0)
        ends[max(ends)] |= 1 << r
    groups: dict[tuple[bool, ...], int] = {}
    kinds = list(dict.fromkeys(s[0] for s in nfa.step if s))
    klass = np.zeros(256, np.uint8)
    for b in range(256):
        klass[b] = groups.setdefault(tuple(b in k for k in kinds), len(groups))
    inside = {k: frozenset(c for sig, c in groups.items() if sig[i]) for i, k in enumerate(kinds)}
    root = _closure(nfa, begins)
    near = {s: _closure(nfa, [nfa.step[s][1]]) for s in range(len(nfa.step)) if nfa.step[s]}
    useful = frozenset(near) | frozenset(ends)
    root &= useful
    near = {s: near[s] & useful for s in near}
    on = {s: inside[nfa.step[s][0]] for s in near}
    ids, rows, order = {root: 0}, [], [root]
    for here in order:
        row = []
        reach: list[set[int]] = [set() if anchored else set(root) for _ in range(len(groups))]
        for s in here:
            for c in on.get(s, ()):
                reach[c] |= near[s]
        for to in map(frozenset, reach):
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, np.int32)
    accepts = np.array([sum({ends[s] for s in x if s in ends}) for x in order], np.int64)
    return _minimal(klass, table, accepts)


def _minimal(klass: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Refines the partition by what is accepted until no class splits (Moore)."""
    part = np.unique(accepts, return_inverse=True)[1]
    # the start stays by itself: a scan reads from it that no rule has begun
    part = part + 1
    part[0] = 0
    while True:
        rows = np.concatenate([part[:, None], part[table]], axis=1)
        finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max() and len(np.unique(finer)) == len(np.unique(part)):
            break
        part = finer
    _, first = np.unique(part, return_index=True)
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    part = rank[np.unique(part, return_inverse=True)[1]]
    first = np.sort(first)
    new = part[table[first]].astype(np.int32)
    acc = accepts[first]
    dead = np.flatnonzero((new == np.arange(len(new))[:, None]).all(axis=1) & (acc == 0))
    return Automaton(klass, new, acc, int(dead[0]) if len(dead) else -1)


def scan(a: Automaton, data: np.ndarray, begins: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """The state after each byte; the automaton starts anew at each of the offsets ``begins``.

    The bytes are cut into equal lanes that step together, each from the start state. A lane
    whose true first state differs (the last of the lane before) is run again from there until
    it meets the states that it has."""
    n = len(data)
    states = np.zeros(n, np.int32)
    if n == 0:
        return states
    classes = len(a.table[0])
    flat = a.table.reshape(-1)
    klass = a.klass[data].astype(np.int32)
    reset = np.zeros(n, bool)
    reset[begins[begins < n]] = True
    lanes = max(1, min(lanes, n // 64))
    size = -(-n // lanes)
    pad = lanes * size - n
    k = np.concatenate([klass, np.zeros(pad, np.int32)]).reshape(lanes, size).T.copy()
    keep = np.concatenate([~reset, np.zeros(pad, bool)]).reshape(lanes, size).T.astype(np.int32)
    out = np.empty((size, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for i in range(size):
        now = flat[now * keep[i] * classes + k[i]]
        out[i] = now
    states[:] = out.T.reshape(-1)[:n]
    step = a.table.tolist()
    for at in range(size, n, size):
        s, i = int(states[at - 1]), at
        while i < n and not reset[i]:
            s = step[s][klass[i]]
            if s == states[i]:
                break
            states[i] = s
            i += 1
    return states


class Rows(NamedTuple):
    """An automaton as plain lists, for walks over a few bytes: ``step[state][byte]``."""

    step: list[list[int]]
    accepts: list[bool]
    dead: int


def as_rows(a: Automaton) -> Rows:
    return Rows(a.table[:, a.klass].tolist(), (a.accepts != 0).tolist(), a.dead)


def longest(a: Rows, data: bytes, at: int, end: int) -> int:
    """End of the longest match that begins at ``at``, at most ``end``; -1 if there is none."""
    step, accepts, dead = a
    s, found = 0, -1
    for i in range(at, end):
        s = step[s][data[i]]
        if s == dead:
            break
        if accepts[s]:
            found = i + 1
    return found


def beginnings(a: Rows, data: bytes, at: int, end: int) -> list[int]:
    """Where in [at, end) a match begins that ends there too, in order; ``a`` reads backward."""
    step, accepts, _ = a
    s, found = 0, []
    for i in range(end - 1, at - 1, -1):
        s = step[s][data[i]]
        if accepts[s]:
            found.append(i)
    return found[::-1]
