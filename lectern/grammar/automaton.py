"""Syntax trees to minimal automata, by partial derivatives.

What remains to be read of a tree is a tuple of trees; reading one character of
it gives other tuples. Sets of tuples are the states. The languages are finite,
so states can be built from their ends: two with equal successors are one, and
the automaton that comes out is minimal. Numbers follow a breadth-first walk over
sorted characters, so patterns of one language give equal automata.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import cached_property, lru_cache

from lectern.grammar.syntax import Chars, Choice, PatternError, Sequence, Span, Times, Tree, lengths, parse

MAX_STATES = 10_000
Rest = tuple[Tree, ...]


def _readings(rest: Rest) -> tuple[set[tuple[frozenset[str], Rest]], bool]:
    """(members, what remains after one of them) of a remainder, and whether it may end here."""
    found: set[tuple[frozenset[str], Rest]] = set()
    todo, seen, ends = [rest], {rest}, False
    while todo:
        now = todo.pop()
        if not now:
            ends = True
            continue
        head, tail = now[0], now[1:]
        match head:
            case Chars(members):
                found.add((members, tail))
                continue
            case Sequence(parts):
                following = [parts + tail]
            case Choice(options):
                following = [(o, *tail) for o in options]
            case Times(part, low, high):
                more = (Times(part, max(low - 1, 0), high - 1),) if high > 1 else ()
                following = [(part, *more, *tail)] + ([tail] if low == 0 else [])
        for x in following:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return found, ends


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton; state 0 starts, and there is no dead state."""

    steps: tuple[dict[str, int], ...]
    accepting: frozenset[int]
    span: Span

    def step(self, state: int, char: str) -> int | None:
        """The state after char, or None."""
        return self.steps[state].get(char)

    def allowed(self, state: int) -> list[str]:
        """The characters that may follow, sorted."""
        return sorted(self.steps[state])

    @cached_property
    def alphabet(self) -> frozenset[str]:
        """All characters of the language."""
        return frozenset(c for s in self.steps for c in s)

    def edges(self) -> list[tuple[int, str, int]]:
        """(state, character, state), sorted."""
        return sorted((i, c, j) for i, s in enumerate(self.steps) for c, j in s.items())

    def matches(self, text: str) -> bool:
        """Whether text as a whole is in the language."""
        state: int | None = 0
        for c in text:
            state = self.steps[state].get(c)
            if state is None:
                return False
        return state in self.accepting


def build(tree: Tree, pattern: str, max_states: int = MAX_STATES) -> Automaton:
    """The minimal automaton of tree; too_complex past max_states sets of remainders."""
    start = frozenset([(tree,)])
    plan: dict[frozenset[Rest], tuple[dict[str, frozenset[Rest]], bool]] = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in plan:
            continue
        if len(plan) >= max_states:
            raise PatternError("too_complex", pattern, 0)
        after: dict[str, set[Rest]] = {}
        ends = False
        for rest in state:
            found, over = _readings(rest)
            ends |= over
            for members, tail in found:
                for c in members:
                    after.setdefault(c, set()).add(tail)
        sets: dict[frozenset[Rest], frozenset[Rest]] = {}
        moves = {c: sets.setdefault(f := frozenset(s), f) for c, s in after.items()}
        plan[state] = (moves, ends)
        todo.extend(sets)
    # states from their ends: equal moves and equal acceptance are one state
    merged: dict[frozenset[Rest], int] = {}
    shapes: dict[tuple, int] = {}
    stack = [start]
    while stack:
        state = stack[-1]
        moves, ends = plan[state]
        missing = [s for s in set(moves.values()) if s not in merged]
        if state in merged or not missing:
            stack.pop()
            if state not in merged:
                shape = (ends, tuple(sorted((c, merged[s]) for c, s in moves.items())))
                merged[state] = shapes.setdefault(shape, len(shapes))
        else:
            stack.extend(missing)
    rows = {i: shape for shape, i in shapes.items()}
    number, queue = {merged[start]: 0}, deque([merged[start]])
    while queue:
        for _, target in rows[queue.popleft()][1]:
            if target not in number:
                number[target] = len(number)
                queue.append(target)
    order = sorted(number, key=number.get)
    steps = tuple({c: number[t] for c, t in rows[i][1]} for i in order)
    return Automaton(steps, frozenset(number[i] for i in order if rows[i][0]), lengths(tree))


@lru_cache(256)
def compile_pattern(pattern: str) -> Automaton:
    """The automaton of a pattern; compiled ones are remembered."""
    return build(parse(pattern), pattern)
