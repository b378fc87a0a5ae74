"""Rule regexes compiled together: Thompson automaton, subset construction, minimisation, transition arrays over bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ALL = (1 << 256) - 1
_NAMED = {"d": "0-9", "w": "A-Za-z0-9_", "s": " \t\n\r\f\v"}


def _bits(chars) -> int:
    out = 0
    for c in chars:
        out |= 1 << c
    return out


@dataclass
class _Nfa:
    """Edges by state: (set of bytes as bits, next), and empty moves."""

    icase: bool = False
    edges: list[list[tuple[int, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def fold(self, bits: int) -> int:
        if self.icase:
            low, high = _bits(range(97, 123)), _bits(range(65, 91))
            bits |= (bits & low) >> 32 | (bits & high) << 32
        return bits

    # A node is a function of the state before it that gives the state after it.
    def add(self, node, at: int) -> int:
        kind, *args = node
        if kind == "set":
            end = self.state()
            self.edges[at].append((self.fold(args[0]), end))
            return end
        if kind == "seq":
            for x in args[0]:
                at = self.add(x, at)
            return at
        if kind == "any":
            end = self.state()
            for x in args[0]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(x, start)].append(end)
            return end
        body, low, high = args
        for _ in range(low):
            at = self.add(body, at)
        if high is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(body, loop)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[at].append(end)
        for _ in range(high - low):
            at = self.add(body, at)
            self.empty[at].append(end)
        return end


def parse(pattern: str):
    """A tree of ASCII regex: literals, escapes, [sets], (groups), |, ?, *, +, {m,n}."""
    p, i = pattern, 0

    def escape() -> int:
        nonlocal i
        c = p[i]
        i += 1
        if c == "x":
            i += 2
            return 1 << int(p[i - 2 : i], 16)
        if c.lower() in _NAMED:
            bits = one_set(_NAMED[c.lower()])
            return bits if c.islower() else ALL & ~bits
        return 1 << ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def one_set(body: str) -> int:
        bits, k = 0, 0
        while k < len(body):
            if k + 2 < len(body) and body[k + 1] == "-":
                bits |= _bits(range(ord(body[k]), ord(body[k + 2]) + 1))
                k += 3
            else:
                bits |= 1 << ord(body[k])
                k += 1
        return bits

    def char_set() -> int:
        nonlocal i
        negate = p[i] == "^"
        i += negate
        start, bits = i, 0
        end = p.index("]", i + 1)
        body = p[start:end]
        i = end + 1
        while "\\" in body:
            k = body.index("\\")
            keep, i = i, start + k + 1
            bits |= escape()
            body = body[:k] + body[i - start :]
            start, i = start + (i - start - k), keep
        bits |= one_set(body)
        return ALL & ~bits if negate else bits

    def choice():
        nonlocal i
        branches = [sequence()]
        while i < len(p) and p[i] == "|":
            i += 1
            branches.append(sequence())
        return branches[0] if len(branches) == 1 else ("any", branches)

    def sequence():
        nonlocal i
        items = []
        while i < len(p) and p[i] not in "|)":
            c = p[i]
            i += 1
            if c == "(":
                if p.startswith("?:", i):
                    i += 2
                node = choice()
                i += 1
            elif c == "[":
                node = ("set", char_set())
            elif c == "\\":
                node = ("set", escape())
            else:
                node = ("set", ALL & ~(1 << 10) if c == "." else 1 << ord(c))
            while i < len(p) and p[i] in "?*+{":
                if p[i] == "{":
                    low, _, high = (body := p[i + 1 : p.index("}", i)]).partition(",")
                    i = p.index("}", i) + 1
                    node = ("repeat", node, int(low), int(low) if "," not in body else int(high) if high else None)
                else:
                    node = ("repeat", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[p[i]])
                    i += 1
            items.append(node)
        return ("seq", items)

    return choice()


def _backwards(node):
    kind, *args = node
    if kind == "set":
        return node
    if kind == "seq":
        return "seq", [_backwards(x) for x in reversed(args[0])]
    if kind == "any":
        return "any", [_backwards(x) for x in args[0]]
    return "repeat", _backwards(args[0]), *args[1:]


@dataclass(frozen=True)
class Dfa:
    """``step[state * classes + class_of[byte]]`` is the next state; ``accepts[state]`` has a bit for each rule. State 0 starts."""

    class_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    classes: int
    dead: int


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool, backwards: bool = False) -> Dfa:
    """One automaton of all rules (pattern, letters in either case). ``anywhere``: a match may begin at any byte.

    Each rule is made deterministic and minimal by itself; the states of the whole are the tuples
    of theirs that some text reaches, minimised again.
    """
    parts = [_compile(p, i, anywhere, backwards) for p, i in rules]
    if len(parts) == 1:
        return parts[0]
    kinds: dict[tuple[int, ...], int] = {}
    class_of = np.array([kinds.setdefault(tuple(int(d.class_of[b]) for d in parts), len(kinds)) for b in range(256)], dtype=np.int32)
    steps = [d.step.reshape(-1, d.classes)[:, [k[j] for k in kinds]].tolist() for j, d in enumerate(parts)]
    first = (0,) * len(parts)
    ids, order, table = {first: 0}, [first], []
    for state in order:
        row = []
        for to in zip(*(t[s] for t, s in zip(steps, state, strict=True)), strict=True):
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        table.append(row)
    accepts = np.array([sum(1 << j for j, (d, s) in enumerate(zip(parts, state, strict=True)) if d.accepts[s]) for state in order])
    return _minimal(class_of, np.array(table), accepts, len(kinds))


def _compile(pattern: str, icase: bool, anywhere: bool, backwards: bool) -> Dfa:
    nfa = _Nfa(icase)
    start = nfa.state()
    tree = parse(pattern)
    at = nfa.state()
    nfa.empty[start].append(at)
    final = {nfa.add(_backwards(tree) if backwards else tree, at): 1}
    if anywhere:
        nfa.edges[start].append((ALL, start))

    # bytes that no edge tells apart are one class
    sets = sorted({b for e in nfa.edges for b, _ in e})
    kinds: dict[tuple[bool, ...], int] = {}
    class_of = np.array([kinds.setdefault(tuple(bool(s >> b & 1) for s in sets), len(kinds)) for b in range(256)], dtype=np.int32)
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(kinds))]

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(s for s in seen if nfa.edges[s] or s in final)

    first = closure([start])
    ids, order, table = {first: 0}, [first], []
    for subset in order:
        row = []
        for b in sample:
            to = closure({n for s in subset for bits, n in nfa.edges[s] if bits >> b & 1})
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        table.append(row)
    accepts = np.array([sum(final.get(s, 0) for s in subset) for subset in order], dtype=np.int64)
    return _minimal(class_of, np.array(table, dtype=np.int64), accepts, len(sample))


def _minimal(class_of: np.ndarray, table: np.ndarray, accepts: np.ndarray, classes: int) -> Dfa:
    # Moore: states stay together while their accepts and the groups of their successors agree
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    place = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}
    group = np.array([place[g] for g in group.tolist()])
    _, one = np.unique(group, return_index=True)
    step = group[table[one]]
    dead = [s for s in range(len(one)) if not accepts[one[s]] and (step[s] == s).all()]
    return Dfa(class_of, step.astype(np.int32).ravel(), accepts[one], classes, dead[0] if dead else -1)
