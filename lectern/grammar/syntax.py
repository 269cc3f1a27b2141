"""Patterns to syntax trees.

A pattern describes finitely many non-empty strings. A scanner turns it into
symbols from left to right and a stack of open groups takes them in, so the first
fault from the left is the one reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

MAX_REPEAT = 64
MAX_LENGTH = 256
MAX_CLASS = 512
MAX_DEPTH = 16
_DIGITS = frozenset("0123456789")
_PUNCTUATION = frozenset(chr(c) for c in range(0x20, 0x7F) if not chr(c).isalnum())

# The stable codes of faults, with what each says.
MESSAGES = {
    "empty_pattern": "the pattern is empty",
    "matches_empty": "the pattern also describes the empty text",
    "too_long": "the pattern describes texts longer than 256 characters",
    "too_complex": "the pattern needs too many automaton states",
    "unbalanced_paren": "a parenthesis has no partner",
    "unbalanced_bracket": "a character class is not closed",
    "unbalanced_brace": "a quantifier is not closed",
    "empty_group": "a group holds nothing",
    "empty_alternative": "an alternative holds nothing; {0,1} makes a part optional",
    "empty_class": "a character class holds nothing",
    "nested_too_deep": "groups are nested more than 16 deep",
    "unbounded_quantifier": "a repetition needs an upper bound, {n} or {n,m}",
    "unsupported_quantifier": "? is no quantifier here; write {0,1}",
    "invalid_quantifier": "a quantifier is {n} or {n,m} after one atom, n <= m, m > 0",
    "repeat_too_large": "a quantifier goes to 64 at most",
    "anchor": "patterns always describe the whole text; there are no anchors",
    "wildcard": "list the allowed characters in a class instead of .",
    "unescaped_special": "this character needs a backslash",
    "group_extension": "groups starting with (? are not supported",
    "unsupported_escape": r"only \d and escaped punctuation are supported",
    "backreference": "backreferences are not supported",
    "negated_class": "negated classes are not supported",
    "invalid_range": "a range goes from one character up to another",
    "class_too_large": "a class or range holds 512 characters at most",
    "control_character": "control characters are not allowed",
}


class PatternError(ValueError):
    """A pattern outside the grammar: a stable code, the code point at fault, and where the pattern stands, if known."""

    def __init__(self, code: str, pattern: str, position: int, location: str | None = None) -> None:
        self.code, self.pattern, self.position, self.location = code, pattern, position, location
        at = f"{location}: " if location else ""
        super().__init__(f"{at}{MESSAGES[code]} [{code}]\n  {pattern}\n  {' ' * position}^")

    def at(self, location: str) -> PatternError:
        """The same fault, placed in a document."""
        return PatternError(self.code, self.pattern, self.position, location)


@dataclass(frozen=True)
class Chars:
    """One character out of a set."""

    members: frozenset[str]


@dataclass(frozen=True)
class Sequence:
    """Parts one after another."""

    parts: tuple[Tree, ...]


@dataclass(frozen=True)
class Choice:
    """One of several options."""

    options: tuple[Tree, ...]


@dataclass(frozen=True)
class Times:
    """A part low to high times."""

    part: Tree
    low: int
    high: int


Tree = Chars | Sequence | Choice | Times


class Span(NamedTuple):
    """Shortest and longest length."""

    low: int
    high: int


def lengths(tree: Tree) -> Span:
    """Length bounds of the strings a tree describes."""
    match tree:
        case Chars():
            return Span(1, 1)
        case Sequence(parts):
            spans = [lengths(p) for p in parts]
            return Span(sum(s.low for s in spans), sum(s.high for s in spans))
        case Choice(options):
            spans = [lengths(o) for o in options]
            return Span(min(s.low for s in spans), max(s.high for s in spans))
        case Times(part, low, high):
            inner = lengths(part)
            return Span(low * inner.low, high * inner.high)
    raise TypeError(tree)


def is_control(char: str) -> bool:
    """C0, DEL and C1."""
    return ord(char) < 0x20 or 0x7F <= ord(char) <= 0x9F


class _Symbol(NamedTuple):
    kind: str  # set ( ) | {} end
    at: int
    value: object = None


class _Scanner:
    def __init__(self, pattern: str) -> None:
        self.text = pattern

    def fault(self, code: str, at: int) -> PatternError:
        return PatternError(code, self.text, at)

    def escaped(self, at: int) -> tuple[frozenset[str], int]:
        """Members and end of the escape whose backslash is at."""
        following = self.text[at + 1 : at + 2]
        if following == "d":
            return _DIGITS, at + 2
        if following and following in _PUNCTUATION:
            return frozenset(following), at + 2
        raise self.fault("backreference" if following.isdigit() else "unsupported_escape", at)

    def single(self, at: int) -> tuple[frozenset[str], int]:
        if is_control(self.text[at]):
            raise self.fault("control_character", at)
        return frozenset(self.text[at]), at + 1

    def member(self, at: int) -> tuple[frozenset[str], int]:
        if self.text[at] == "\\":
            return self.escaped(at)
        if self.text[at] == "[":
            raise self.fault("unescaped_special", at)
        return self.single(at)

    def between(self, low: frozenset[str], high: frozenset[str], at: int, high_at: int) -> frozenset[str]:
        for ends, place in ((low, at), (high, high_at)):
            if len(ends) > 1:
                raise self.fault("invalid_range", place)
        first, last = ord(min(low)), ord(min(high))
        if first > last:
            raise self.fault("invalid_range", at)
        if last - first >= MAX_CLASS:
            raise self.fault("class_too_large", at)
        found = frozenset(map(chr, range(first, last + 1)))
        if any(map(is_control, found)):
            raise self.fault("control_character", at)
        return found

    def bracket(self, start: int) -> tuple[frozenset[str], int]:
        """Members and end of the class opened at start."""
        at, text, found = start + 1, self.text, frozenset()
        if text.startswith("^", at):
            raise self.fault("negated_class", at)
        while not text.startswith("]", at):
            if at >= len(text):
                raise self.fault("unbalanced_bracket", start)
            some, end = self.member(at)
            if text.startswith("-", end) and end + 1 < len(text) and text[end + 1] != "]":
                high, stop = self.member(end + 1)
                some, end = self.between(some, high, at, end + 1), stop
            found, at = found | some, end
            if len(found) > MAX_CLASS:
                raise self.fault("class_too_large", start)
        if not found:
            raise self.fault("empty_class", at)
        return found, at + 1

    def braces(self, start: int) -> tuple[tuple[int, int], int]:
        """Bounds and end of the quantifier opened at start."""
        stop = self.text.find("}", start)
        if stop < 0:
            raise self.fault("unbalanced_brace", start)
        bounds = self.text[start + 1 : stop].split(",", 1)
        numeric = [b.isascii() and b.isdigit() for b in bounds]
        if numeric == [True, False] and not bounds[1]:
            raise self.fault("unbounded_quantifier", start)
        if not all(numeric):
            raise self.fault("invalid_quantifier", start)
        low, high = int(bounds[0]), int(bounds[-1])
        if low > high or high == 0:
            raise self.fault("invalid_quantifier", start)
        if high > MAX_REPEAT:
            raise self.fault("repeat_too_large", start)
        return (low, high), stop + 1

    # characters that cannot stand where an atom could start
    STRAY = {"*": "unbounded_quantifier", "+": "unbounded_quantifier", "?": "unsupported_quantifier", "{": "invalid_quantifier", "^": "anchor", "$": "anchor", ".": "wildcard", "]": "unescaped_special", "}": "unescaped_special"}

    def symbols(self) -> Iterator[_Symbol]:
        at, text, repeatable = 0, self.text, False
        while at < len(text):
            char, start = text[at], at
            if char == "{" and repeatable:
                bounds, at = self.braces(start)
                yield _Symbol("{}", start, bounds)
                if text[at : at + 1] and text[at] in "{*+?":
                    raise self.fault("invalid_quantifier", at)
                repeatable = False
            elif char in "(|":
                at, repeatable = at + 1, False
                yield _Symbol(char, start)
            elif char == ")":
                at, repeatable = at + 1, True
                yield _Symbol(char, start)
            elif char in self.STRAY:
                raise self.fault(self.STRAY[char], at)
            else:
                members, at = self.bracket(at) if char == "[" else self.escaped(at) if char == "\\" else self.single(at)
                repeatable = True
                yield _Symbol("set", start, members)
        yield _Symbol("end", len(text))


class _Open:
    """A group being read: finished options and the parts of the current one."""

    def __init__(self, at: int) -> None:
        self.at = at
        self.options: list[Tree] = []
        self.parts: list[Tree] = []

    def finish_option(self) -> None:
        self.options.append(self.parts[0] if len(self.parts) == 1 else Sequence(tuple(self.parts)))
        self.parts = []

    def tree(self) -> Tree:
        return self.options[0] if len(self.options) == 1 else Choice(tuple(self.options))


def parse(pattern: str) -> Tree:
    """The tree of a pattern; PatternError for the first fault from the left, then for bad lengths."""
    if not isinstance(pattern, str):
        raise TypeError(f"a pattern is a str, not {type(pattern).__name__}")
    if not pattern:
        raise PatternError("empty_pattern", pattern, 0)
    scanner, stack = _Scanner(pattern), [_Open(0)]
    for kind, at, value in scanner.symbols():
        top = stack[-1]
        if kind == "set":
            top.parts.append(Chars(value))
        elif kind == "{}":
            top.parts[-1] = Times(top.parts[-1], *value)
        elif kind == "(":
            if pattern.startswith("?", at + 1):
                raise scanner.fault("group_extension", at + 1)
            if pattern.startswith(")", at + 1):
                raise scanner.fault("empty_group", at + 1)
            if len(stack) > MAX_DEPTH:
                raise scanner.fault("nested_too_deep", at)
            stack.append(_Open(at))
        else:  # | ) end: an option is over
            if kind == ")" and len(stack) == 1:
                raise scanner.fault("unbalanced_paren", at)
            if not top.parts:
                raise scanner.fault("empty_alternative", at)
            top.finish_option()
            if kind == ")":
                stack.pop()
                stack[-1].parts.append(top.tree())
            elif kind == "end" and len(stack) > 1:
                raise scanner.fault("unbalanced_paren", top.at)
    tree = stack[0].tree()
    span = lengths(tree)
    if not span.low:
        raise PatternError("matches_empty", pattern, 0)
    if span.high > MAX_LENGTH:
        raise PatternError("too_long", pattern, 0)
    return tree
