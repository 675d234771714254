"""Regular expressions to one minimal deterministic automaton over bytes.

A small dialect: literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+``,
``{m}``, ``{m,}``, ``{m,n}`` and a leading ``(?i)``.  Rules are joined into one
nondeterministic automaton, made deterministic by subset construction over byte
classes and minimised by partition refinement; states carry the set of rules that
end there as a bit mask.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_SETS = {"d": "0123456789", "w": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", "s": "\t\n\f\r "}
EMPTY = ("cat", [])


class _Parser:
    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.p, self.i = pattern[4 * self.fold :], 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def next(self) -> str:
        if self.i >= len(self.p):
            raise ValueError(f"pattern ends too soon: {self.p!r}")
        self.i += 1
        return self.p[self.i - 1]

    def parse(self):
        tree = self.either()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} in {self.p!r}")
        return tree

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.next()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, atom):
        while (c := self.peek()) and c in "?*+{":
            self.next()
            if c == "{":
                text = ""
                while (d := self.next()) != "}":
                    text += d
                low, comma, high = text.partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("repeat", atom, least, most)
        return atom

    def atom(self):
        c = self.next()
        if c == "(":
            if self.peek() == "?":
                self.next()
                if self.next() != ":":
                    raise ValueError(f"only (?: groups are known: {self.p!r}")
            tree = self.either()
            if self.next() != ")":
                raise ValueError(f"open group in {self.p!r}")
            return tree
        if c == "[":
            return self.bracket()
        if c == "\\":
            return self.one(self.escape())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c in "^$*+?{)":
            raise ValueError(f"unexpected {c!r} in {self.p!r}")
        return self.one(c)

    def escape(self) -> str:
        c = self.next()
        return _SETS.get(c) or _ESCAPES.get(c, c)

    def one(self, chars: str):
        if len(chars) == 1 and ord(chars) > 127:
            return ("cat", [("set", frozenset([b])) for b in chars.encode()])
        found = set(chars.encode())
        if self.fold:
            found |= set(chars.lower().encode()) | set(chars.upper().encode())
        return ("set", frozenset(found))

    def bracket(self):
        negated = self.peek() == "^"
        if negated:
            self.next()
        found: set[int] = set()
        while (c := self.next()) != "]":
            chars = self.escape() if c == "\\" else c
            if len(chars) == 1 and self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.next()
                end = self.next()
                chars = "".join(map(chr, range(ord(chars), ord(self.escape() if end == "\\" else end) + 1)))
            if any(ord(x) > 127 for x in chars):
                raise ValueError("classes hold ASCII only")
            found |= set(chars.encode())
            if self.fold:
                found |= set(chars.lower().encode()) | set(chars.upper().encode())
        return ("set", frozenset(range(256)) - found if negated else frozenset(found))


def parse(pattern: str):
    return _Parser(pattern).parse()


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    if kind == "repeat":
        return ("repeat", reverse(tree[1]), tree[2], tree[3])
    return tree


def head(tree, most: int):
    """Of a rule that ends in a repetition, the rule that ends after `most` times at the latest.

    It matches a beginning of every match of the rule.  Long counts of several
    rules at once would multiply the states of a joint automaton that looks for
    them from every place.
    """
    kind = tree[0]
    if kind == "cat" and tree[1]:
        return ("cat", [*tree[1][:-1], head(tree[1][-1], most)])
    if kind == "or":
        return ("or", [head(x, most) for x in tree[1]])
    if kind == "repeat":
        return ("repeat", tree[1], *[min(tree[2], most)] * 2)
    return tree


@dataclass
class Automaton:
    """`table[state * n_classes + classes[byte]]` is the next state, times n_classes.

    `accept[state]` has bit r set where rule r ends.  State 0 is the start; states
    that accept come last, from `first_accept` on.  `dead` is a state with no way
    out, or -1.
    """

    classes: np.ndarray
    table: np.ndarray
    accept: list[int]
    n_classes: int
    first_accept: int
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.accept)


def compile_rules(trees: list, search: bool, every: bool = False) -> Automaton:
    """The minimal automaton of all trees; with `search`, of any text before them.

    A search automaton tells which rules match, not every place where they do:
    while a rule that ends in a repeated class counts, a count that started later
    can't finish first and is left out, which keeps the states few.  With `every`
    nothing is left out.
    """
    edges: list[list[tuple[frozenset[int], int]]] = []
    empty: list[list[int]] = []
    ends: dict[int, int] = {}
    counted: dict[int, tuple[int, int]] = {}  # node of a class's count at a rule's end: (count, times so far)
    counts = [0]

    def node() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    def build(tree, a: int, b: int, last: bool) -> None:
        kind = tree[0]
        if kind == "set":
            edges[a].append((tree[1], b))
        elif kind == "cat":
            for k, item in enumerate(tree[1]):
                mid = node()
                build(item, a, mid, last and k == len(tree[1]) - 1)
                a = mid
            empty[a].append(b)
        elif kind == "or":
            for item in tree[1]:
                build(item, a, b, last)
        else:
            _, item, least, most = tree
            counts[0] += 1
            for k in range(least):
                mid = node()
                build(item, a, mid, False)
                a = mid
                if search and not every and last and item[0] == "set":
                    counted[mid] = (counts[0], k)
            if most is None:
                loop = node()
                empty[a].append(loop)
                build(item, loop, loop, False)
                a = loop
            else:
                for _ in range(most - least):
                    mid = node()
                    build(item, a, mid, False)
                    empty[a].append(b)
                    a = mid
            empty[a].append(b)

    start = node()
    for r, tree in enumerate(trees):
        a, b = node(), node()
        empty[start].append(a)
        build(tree, a, b, True)
        ends[b] = r

    sets = {s for out in edges for s, _ in out}
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, dtype=np.uint8)
    ordered = sorted(sets, key=sorted)
    for byte in range(256):
        classes[byte] = signature.setdefault(tuple(byte in s for s in ordered), len(signature))
    width = len(signature)
    members = {s: sorted({int(classes[b]) for b in s}) for s in sets}
    closures: dict[int, frozenset[int]] = {}

    def closure(n: int) -> frozenset[int]:
        if n not in closures:
            seen, todo = {n}, [n]
            while todo:
                for m in empty[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            closures[n] = frozenset(seen)
        return closures[n]

    def ahead(nodes: set[int]) -> set[int]:
        most: dict[int, int] = {}
        for n in nodes:
            if n in counted:
                most[counted[n][0]] = max(most.get(counted[n][0], 0), counted[n][1])
        return {n for n in nodes if n not in counted or most[counted[n][0]] == counted[n][1]}

    first = closure(start)
    number = {first: 0}
    todo, rows = [first], []
    while todo:
        state = todo.pop(0)
        to: list[set[int]] = [set() for _ in range(width)]
        for n in state:
            for s, m in edges[n]:
                for c in members[s]:
                    to[c] |= closure(m)
        row = []
        for targets in to:
            target = frozenset(ahead(targets) | first) if search else frozenset(targets)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    accept = [0] * len(rows)
    for state, k in number.items():
        for n in state:
            if n in ends:
                accept[k] |= 1 << ends[n]

    # minimise: split by what is accepted, then by the parts that the classes lead to
    names: dict = {}
    part = np.array([names.setdefault(a, len(names)) for a in accept])
    to_all = np.array(rows)
    while True:
        _, fine = np.unique(np.concatenate([part[:, None], part[to_all]], axis=1), axis=0, return_inverse=True)
        fine = fine.ravel()
        if fine.max() == part.max():
            break
        part = fine
    n = int(part.max()) + 1
    example = np.zeros(n, dtype=np.int64)
    example[part[::-1]] = np.arange(len(part))[::-1]
    masks = [accept[e] for e in example]
    order = sorted(range(n), key=lambda k: (k != part[0], bool(masks[k]), k))
    if masks[part[0]]:
        raise ValueError("a rule matches the empty text")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    table = np.array([[place[part[t]] for t in rows[example[k]]] for k in order], dtype=np.int64)
    masks = [masks[k] for k in order]
    dead = [k for k in range(n) if not masks[k] and (table[k] == k).all()]
    return Automaton(classes, (table * width).astype(np.int32).ravel(), masks, width, sum(not m for m in masks), dead[0] if dead and not search else -1)


def _wide(a: Automaton) -> np.ndarray:
    """The table with one class more, of what separates texts, which leads to the start."""
    table = np.zeros((a.n_states, a.n_classes + 1), dtype=np.int32)
    table[:, :-1] = a.table.reshape(a.n_states, a.n_classes) // a.n_classes * (a.n_classes + 1)
    return table.ravel()


class Scanner:
    """Leftmost-longest matches of each rule that don't overlap, as a search from left to right finds them.

    Three minimal automata of all rules together.  The first knows their openings
    (all up to the first byte of a count at a rule's end; counts of several rules at
    once would multiply its states) and runs once over all bytes, many stretches in
    step; where it accepts, it tells rule and place.  From there the second, of the
    reversed openings, finds where they begin, and the third, of the full rules,
    where the longest match from there ends; both take all places in step.  `reach`
    must be at least the bytes from a match's first to the first byte at which it is
    accepted: a stretch starts that far ahead of its own bytes.
    """

    def __init__(self, patterns: list[str], reach: int = 96, stretch: int = 480):
        if len(patterns) > 63:
            raise ValueError("at most 63 rules fit a mask")
        trees = [parse(p) for p in patterns]
        self.openings = compile_rules([head(t, 1) for t in trees], search=True, every=True)
        self.backward = compile_rules([reverse(head(t, 1)) for t in trees], search=False)
        self.forward = compile_rules(trees, search=False)
        if max(shortest_reach(compile_rules([t], search=False)) for t in trees) > reach:
            raise ValueError("a rule's first end may be further than `reach`")
        self.n_rules, self.reach, self.stretch = len(trees), reach, stretch
        self.table = _wide(self.openings)
        self.masks = {k: np.array(a.accept, dtype=np.uint64) for k, a in (("openings", self.openings), ("backward", self.backward), ("forward", self.forward))}
        self.stays: dict[int, np.ndarray] = {}

    def _opened(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place after the last byte, and rule of every opening."""
        a = self.openings
        n_docs, total = len(off) - 1, len(data) + len(off) - 1
        stream = np.full(total, a.n_classes, dtype=np.uint8)  # a separator after each text
        stream[np.arange(len(data)) + np.repeat(np.arange(n_docs), np.diff(off))] = a.classes[data]
        n = -(-total // self.stretch)
        span = self.stretch + self.reach
        padded = np.full(self.reach + n * self.stretch, a.n_classes, dtype=np.uint8)
        padded[self.reach : self.reach + total] = stream
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (span, n), (1, self.stretch)))
        state, at = np.zeros(n, np.int32), np.empty(n, np.int64)
        own = np.empty((self.stretch, n), np.int32)
        for k, row in enumerate(steps):
            np.add(state, row, out=at)
            state = own[k - self.reach] if k >= self.reach else np.empty(n, np.int32)
            np.take(self.table, at, out=state, mode="clip")
        step, lane = np.nonzero(own >= a.first_accept * (a.n_classes + 1))
        found = self.masks["openings"][own[step, lane] // (a.n_classes + 1)]
        place = lane * self.stretch + step  # in the stream
        row = np.searchsorted(off[1:] + np.arange(1, n_docs + 1), place, side="right")
        which, rule = np.nonzero((found[:, None] >> np.arange(self.n_rules, dtype=np.uint64)) & np.uint64(1))
        return row[which], place[which] - row[which] + 1, rule

    def _begun(self, data: np.ndarray, off: np.ndarray, row: np.ndarray, place: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """(row, rule, start), sorted and each once, of the openings that end at these places."""
        a, masks = self.backward, self.masks["backward"]
        state, at, least = np.zeros(len(row), np.int64), place.copy(), off[row]
        shift, key = rule.astype(np.uint64), np.stack([row, rule], axis=1)
        found = []
        for _ in range(self.reach):
            live = (at > least) & (state != a.dead * a.n_classes)
            if not live.all():
                state, at, least, shift, key = (x[live] for x in (state, at, least, shift, key))
            if not len(at):
                break
            at -= 1
            state = a.table[state + a.classes[data[at]]].astype(np.int64)
            hit = (masks[state // a.n_classes] >> shift) & np.uint64(1) > 0
            if hit.any():
                found.append(np.column_stack([key[hit], at[hit]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def _ended(self, data: np.ndarray, off: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """End of the longest match from each start, 0 if none; and (state, place) of those that go on beyond 4 * reach bytes."""
        a, masks = self.forward, self.masks["forward"]
        end = np.zeros(len(begun), np.int64)
        k, at, last, shift = np.arange(len(begun)), begun[:, 2].copy(), off[begun[:, 0] + 1], begun[:, 1].astype(np.uint64)
        state = np.zeros(len(begun), np.int64)
        for _ in range(4 * self.reach):
            live = (at < last) & (state != a.dead * a.n_classes)
            if not live.all():
                state, at, last, shift, k = (x[live] for x in (state, at, last, shift, k))
            if not len(at):
                break
            state = a.table[state + a.classes[data[at]]].astype(np.int64)
            at += 1
            hit = (masks[state // a.n_classes] >> shift) & np.uint64(1) > 0
            end[k[hit]] = at[hit]
        return end, {int(i): (int(q), int(p)) for i, q, p in zip(k, state, at, strict=True) if q != a.dead * a.n_classes and p < off[begun[i, 0] + 1]}

    def _run_on(self, data: np.ndarray, rule: int, state: int, at: int, last: int, end: int) -> int:
        """The end of a match that goes on: bytes that leave a state as it is are skipped at once."""
        a = self.forward
        while at < last and state != a.dead * a.n_classes:
            q = state // a.n_classes
            if q not in self.stays:
                self.stays[q] = (a.table[state : state + a.n_classes] == state)[a.classes]
            part = data[at : min(last, at + (1 << 16))]
            leaves = ~self.stays[q][part]
            n = int(leaves.argmax()) if leaves.any() else len(part)
            at += n
            if n and a.accept[q] >> rule & 1:
                end = at
            if n < len(part):
                state = int(a.table[state + int(a.classes[data[at]])])
                at += 1
                if a.accept[state // a.n_classes] >> rule & 1:
                    end = at
        return end

    def scan(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(row, rule, start, end) of all matches by row, rule and place; places in bytes of `data`."""
        if not len(data):
            return np.zeros((0, 4), np.int64)
        begun = self._begun(data, off, *self._opened(data, off))
        end, open_ = self._ended(data, off, begun)
        out, group, free = [], (-1, -1), 0
        for k, (row, rule, start) in enumerate(begun.tolist()):
            if (row, rule) != group:
                group, free = (row, rule), 0
            if start < free:
                continue
            stop = int(end[k])
            if k in open_:
                stop = self._run_on(data, rule, *open_[k], int(off[row + 1]), stop)
            if stop:
                out.append((row, rule, start, stop))
                free = stop
        return np.array(out, dtype=np.int64).reshape(-1, 4)

    def flagged(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that hold a match."""
        return np.unique(self.scan(data, off)[:, 0])

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes of one text, by rule and start."""
        data = np.frombuffer(text, dtype=np.uint8)
        return [tuple(m) for m in self.scan(data, np.array([0, len(data)]))[:, 1:].tolist()]


def shortest_reach(a: Automaton) -> int:
    """Most bytes that a text can have before the rule first accepts; raises where there is no limit."""
    to = a.table.reshape(a.n_states, a.n_classes) // a.n_classes
    depth: dict[int, int] = {}

    def longest(s: int, path: frozenset[int]) -> int:
        if s in depth:
            return depth[s]
        if s in path:
            raise ValueError("a rule may go on without end before it is accepted")
        best = 0
        for t in set(to[s].tolist()):
            if t != a.dead:
                best = max(best, 1 if t >= a.first_accept else 1 + longest(t, path | {s}))
        depth[s] = best
        return best

    return longest(0, frozenset())
