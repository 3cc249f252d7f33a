"""Several regexes as one minimal deterministic automaton over bytes, held in transition arrays."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np

_ALL = frozenset(range(256))
_CATEGORY = {
    C.CATEGORY_DIGIT: frozenset(b"0123456789"),
    C.CATEGORY_SPACE: frozenset(b" \t\n\r\x0b\x0c"),
    C.CATEGORY_WORD: frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}


@dataclass(frozen=True)
class Automaton:
    """``step[state * n_classes + classes[byte]]`` is the next state, already times ``n_classes``; 0 is the start.

    ``accept`` has a bit per rule for each state. ``reset`` marks bytes that lead every state back to the start. ``dead``
    is the state that no rule leaves, -1 if there is none.
    """

    classes: np.ndarray
    step: np.ndarray
    accept: np.ndarray
    reset: np.ndarray
    n_classes: int
    dead: int


class _Nfa:
    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def build(self, tree, at: int, fold: bool, back: bool) -> int:
        """Add the parsed items after state ``at``, in reverse if ``back``; returns the last state."""
        for op, arg in reversed(tree) if back else tree:
            if op is C.SUBPATTERN:
                _, on, off, inner = arg
                at = self.build(inner, at, (fold or bool(on & parser.SRE_FLAG_IGNORECASE)) and not off & parser.SRE_FLAG_IGNORECASE, back)
            elif op is C.BRANCH:
                end = self.state()
                for way in arg[1]:
                    self.free[self.build(way, at, fold, back)].append(end)
                at = end
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, inner = arg
                for _ in range(least):
                    at = self.build(inner, at, fold, back)
                if most is C.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.build(inner, loop, fold, back)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(most - least):
                        at = self.build(inner, at, fold, back)
                        self.free[at].append(end)
                    at = end
            else:
                new = self.state()
                self.edges[at].append((_bytes_of(op, arg, fold), new))
                at = new
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is C.LITERAL:
        found = {arg}
    elif op is C.NOT_LITERAL:
        found = _ALL - {arg}
    elif op is C.ANY:
        found = _ALL - {10}
    elif op is C.IN:
        found, negate = set(), False
        for kind, x in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            elif kind is C.CATEGORY and x in _CATEGORY:
                found |= _CATEGORY[x]
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        found = _ALL - found if negate else found
    else:
        raise ValueError(f"not supported in a rule: {op}")
    if fold:
        found = set(found) | {b for x in found for b in chr(x).swapcase().encode("latin-1", "ignore") if x < 128}
    return frozenset(found)


def compile_rules(patterns: list[str], anywhere: bool = True, back: bool = False) -> Automaton:
    """Subset construction over the rules, then minimisation by partition refinement.

    The rules are searched from any place, or from the first byte only; ``back`` reads them and the bytes backwards.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for rule, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.free[root].append(first)
        tree = parser.parse(pattern.encode())
        ends[nfa.build(tree, first, bool(tree.state.flags & parser.SRE_FLAG_IGNORECASE), back)] = rule

    # bytes that no rule tells apart share a class
    sets = {b for out in nfa.edges for b, _ in out}
    kinds: dict[tuple[bool, ...], int] = {}
    ordered = sorted(sets, key=sorted)
    classes = np.zeros(256, np.uint8)
    sample = []
    for b in range(256):
        k = kinds.setdefault(tuple(b in s for s in ordered), len(kinds))
        if k == len(sample):
            sample.append(b)
        classes[b] = k

    start, always = nfa.closure([root]), {root} if anywhere else set()
    ids, todo, rows = {start: 0}, [start], []
    while todo:
        states = todo.pop(0)
        row = []
        for b in sample:
            to = nfa.closure({t for s in states for on, t in nfa.edges[s] if b in on} | always)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows)
    bits = np.array([sum(1 << ends[s] for s in states if s in ends) for states in ids], np.int64)

    part = np.unique(bits, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # number the parts with the start first
    n = part.max() + 1
    name = np.empty(n, np.int64)
    first_of = np.full(n, -1)
    for s in range(len(part) - 1, -1, -1):
        first_of[part[s]] = s
    order = np.argsort(first_of)
    name[order] = np.arange(n)
    small = name[part[table[first_of[order]]]]
    accept = bits[first_of[order]]
    reset_class = (small == 0).all(axis=0)
    width = len(sample)
    stuck = np.flatnonzero((small == np.arange(n)[:, None]).all(axis=1) & (accept == 0))
    dead = int(stuck[0]) * width if len(stuck) else -1
    return Automaton(classes, (small * width).ravel().astype(np.int32), accept, reset_class[classes], width, dead)


def lanes(a: Automaton, buf: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of stretches of about ``lane`` bytes (longer where nothing resets), the longest first.

    A byte in ``reset`` forgets all that came before, so no match crosses it and the buffer can be cut there.
    """
    resets = np.flatnonzero(a.reset[buf]) + 1
    cut = resets[np.minimum(np.searchsorted(resets, np.arange(lane, len(buf), lane)), len(resets) - 1)] if len(resets) else resets
    bounds = np.unique(np.concatenate([[0], cut, [len(buf)]]))
    starts, size = bounds[:-1], np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    return starts[order], size[order]


def scan(a: Automaton, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """One pass over the bytes of some lanes, the longest first: the rules that accept in each lane, as bits.

    All lanes take their next byte together. With ``marks`` the lanes are read from their ends, and the bits of every
    place go there.
    """
    back = marks is not None
    state, hits = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
    coded = a.classes[buf]
    bits = np.repeat(a.accept, a.n_classes)  # by state times n_classes
    alive = len(starts)
    place = starts + size - 1 if back else starts.copy()
    for t in range(int(size[0]) if len(size) else 0):
        while alive and size[alive - 1] <= t:
            alive -= 1
        at = place[:alive]
        state[:alive] = a.step[state[:alive] + coded[at]]
        found = bits[state[:alive]]
        hits[:alive] |= found
        if back:
            marks[at] = found
        place[:alive] += -1 if back else 1
    return hits


class Matcher:
    """Where rules match: leftmost, longest, and for each rule without overlaps.

    The combined automaton reads every byte once and tells the lanes that hold matches, and of which rules. These lanes
    are read once more from their ends by the automaton of the reversed rules, which marks the places where matches
    start. From the first start on, the automaton of the rules at one place gives the longest match, and so on.
    """

    def __init__(self, patterns: list[str]) -> None:
        self.forward = compile_rules(patterns)
        self.backward = compile_rules(patterns, back=True)
        self.here = compile_rules(patterns, anywhere=False)
        self.steps, self.classes, self.accept = self.here.step.tolist(), self.here.classes.tolist(), self.here.accept.tolist()

    def longest(self, data: bytes, start: int, stop: int, rule: int) -> int:
        """The end of the longest match of a rule at ``start``."""
        state, last, width = 0, start, self.here.n_classes
        for i in range(start, stop):
            state = self.steps[state + self.classes[data[i]]]
            if state == self.here.dead:
                break
            if self.accept[state // width] >> rule & 1:
                last = i + 1
        return last

    def matches(self, buf: np.ndarray, rules: int, lane: int = 1024):
        """(rule, start, end) in the bytes, of the first ``rules`` rules."""
        starts, size = lanes(self.forward, buf, lane)
        hits = scan(self.forward, buf, starts, size)
        held = np.flatnonzero(hits & ((1 << rules) - 1))
        starts, size, hits = starts[held], size[held], hits[held].tolist()
        marks = np.zeros(len(buf), np.int64)
        scan(self.backward, buf, starts, size, marks)
        data = buf.tobytes()
        for s, n, bits in zip(starts.tolist(), size.tolist(), hits, strict=True):
            for rule in range(rules):
                if bits >> rule & 1:
                    begins = np.flatnonzero(marks[s : s + n] >> rule & 1) + s
                    at = 0
                    while at < len(begins):
                        first = int(begins[at])
                        end = self.longest(data, first, s + n, rule)
                        yield rule, first, end
                        at = int(np.searchsorted(begins, end))
