"""Cheapest edits of a sequence of turns, as a dynamic program over persistent strings.

Edits are Keep, Rerole, Delete and Insert; the kept, reroled and inserted turns must read
``(s?(ua)+)?`` by the first letters of their roles. Of all cheapest edits the ASCII-least
string of their initials (the audit) is wanted, so for each state of that expression the
program keeps the cost and the least audit of reaching it. Audits share their beginnings:
each is a node of one tree, with its edit, the node before it, the ancestors 1, 2, 4, ...
nodes up and a rolling hash of the whole string. Two audits of equal cost are compared
where their longest common beginning ends, which is searched over the ancestors' hashes;
that the beginnings are equal is then verified (they nearly always are one node), so a
collision of hashes costs time and never a wrong answer.

Of two audits that reach a state with equal costs after the same turns neither begins the
other: the rest would be inserts, which cost. The least audit of a state therefore begins
a least audit of the whole, and the turns may be worked on in segments: for each state a
segment may begin in, the best way to each state it may end in, joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import zip_longest

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the turns so far end in
FINE, TRUNCATED, MUST_GO = range(3)  # kinds of turns
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1

# Of the letter of a kept turn: the states it may follow, and the state it leads to.
_KEEP = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
# A reroled or inserted turn is the one that the state asks for.
_NEW = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}

Way = tuple[int, str]  # cost and audit


def follow(state: int, edit: str, letter: str) -> int:
    """State after an edit; ``letter`` begins the role of the turn it is done to."""
    if edit == "D":
        return state
    return _KEEP[letter][1] if edit == "K" else _NEW[state]


class AuditTree:
    """Strings as nodes; node 0 is the empty one."""

    BASE, MODULUS = 1_000_003, (1 << 61) - 1

    def __init__(self) -> None:
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, edit: str) -> int:
        ups = [node]
        while len(above := self.up[ups[-1]]) >= len(ups):
            ups.append(above[len(ups) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(edit)) % self.MODULUS)
        self.up.append(tuple(ups))
        return len(self.edit) - 1

    def spelled(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def _lift(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` comes before that of ``y``."""
        level = min(self.depth[x], self.depth[y])
        a, b = self._lift(x, self.depth[x] - level), self._lift(y, self.depth[y] - level)
        if self.hash[a] != self.hash[b]:
            k = len(self.up[a]) - 1
            while k >= 0:  # down to the first nodes that differ
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
                k -= 1
            common, other = self.up[a][0], self.up[b][0]
            if self.edit[a] != self.edit[b] and (common == other or self.spelled(common) == self.spelled(other)):
                return self.edit[a] < self.edit[b]
        elif a == b:
            return self.depth[x] < self.depth[y]
        return self.spelled(x) < self.spelled(y)


class _Program:
    """The best way from one state to every state, turn by turn."""

    def __init__(self, start: int):
        self.tree = AuditTree()
        self.best: list[tuple[int, int] | None] = [None] * 4  # cost and node
        self.best[start] = (0, 0)
        self._insert()

    def _offer(self, best: list, state: int, cost: int, node: int, edit: str) -> None:
        now = best[state]
        if now is None or cost < now[0]:
            best[state] = (cost, self.tree.add(node, edit))
        elif cost == now[0]:
            new = self.tree.add(node, edit)
            if self.tree.less(new, now[1]):
                best[state] = (cost, new)

    def _insert(self) -> None:
        for state in (EMPTY, SYSTEM, ASSISTANT, USER):  # into user first, then out of it
            if self.best[state] is not None:
                cost, node = self.best[state]
                self._offer(self.best, _NEW[state], cost + INSERT_COST, node, "I")

    def turn(self, letter: str, kind: int) -> None:
        then: list[tuple[int, int] | None] = [None] * 4
        extra = TRUNCATED_COST if kind == TRUNCATED else 0
        from_states, to_state = _KEEP.get(letter, ((), EMPTY))
        for state, way in enumerate(self.best):
            if way is None:
                continue
            cost, node = way
            self._offer(then, state, cost + DELETE_COST, node, "D")
            if kind != MUST_GO:
                if state in from_states:
                    self._offer(then, to_state, cost + extra, node, "K")
                self._offer(then, _NEW[state], cost + REROLE_COST + extra, node, "R")
        self.best = then
        self._insert()


class Segment:
    """Ways from each of ``starts`` to every state over the turns given so far."""

    def __init__(self, starts: Iterable[int]):
        self.programs = {s: _Program(s) for s in starts}

    def turn(self, letter: str, kind: int) -> None:
        for p in self.programs.values():
            p.turn(letter, kind)

    def ways(self) -> list[tuple[int, int, int, str]]:
        """(start, end, cost, audit) of every pair of states."""
        return [(s, e, way[0], p.tree.spelled(way[1])) for s, p in self.programs.items()
                for e, way in enumerate(p.best) if way is not None]


class Chain:
    """Segments joined one after another, from the empty state."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, tuple | None]] = {EMPTY: (0, None)}  # cost and linked parts

    @staticmethod
    def _less(x: tuple, y: tuple) -> bool:
        """Order of two linked strings of as many parts, from where they part."""
        xs, ys = [], []
        while x is not y:
            xs.append(x[1])
            ys.append(y[1])
            x, y = x[0], y[0]
        for a, b in zip_longest("".join(reversed(xs)), "".join(reversed(ys)), fillvalue=""):
            if a != b:
                return a < b
        return False

    def add(self, ways: Iterable[tuple[int, int, int, str]]) -> None:
        then: dict[int, tuple[int, tuple]] = {}
        for start, end, cost, audit in ways:
            if start in self.best:
                before, parts = self.best[start]
                new = (before + cost, (parts, audit))
                now = then.get(end)
                if now is None or new[0] < now[0] or new[0] == now[0] and self._less(new[1], now[1]):
                    then[end] = new
        self.best = then

    def result(self) -> Way:
        """Cost and audit of the best whole."""
        found = []
        for state in (EMPTY, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                parts = []
                while node is not None:
                    parts.append(node[1])
                    node = node[0]
                found.append((cost, "".join(reversed(parts))))
        return min(found)


def cheapest(turns: Iterable[tuple[str, int]]) -> Way:
    """Cost and audit of one sequence of (letter, kind)."""
    segment, chain = Segment([EMPTY]), Chain()
    for letter, kind in turns:
        segment.turn(letter, kind)
    chain.add(segment.ways())
    return chain.result()
