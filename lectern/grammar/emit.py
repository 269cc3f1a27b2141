"""Patterns as column expressions: a regular expression, and conditions it implies that scans can use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.grammar.syntax import Chars, Choice, Sequence, Times, Tree, lengths, parse


def _hex(char: str) -> str:
    return f"\\x{{{ord(char):X}}}"


def _runs(members: frozenset[str]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for code in sorted(map(ord, members)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return [(a, b) for a, b in runs]


def _body(tree: Tree) -> str:
    match tree:
        case Chars(members):
            if len(members) == 1:
                return _hex(min(members))
            return "[" + "".join(_hex(chr(a)) + (f"-{_hex(chr(b))}" if b > a else "") for a, b in _runs(members)) + "]"
        case Sequence(parts):
            return "".join(f"(?:{_body(p)})" if isinstance(p, Choice) else _body(p) for p in parts)
        case Choice(options):
            return "(?:" + "|".join(_body(o) for o in options) + ")"
        case Times(part, low, high):
            return f"(?:{_body(part)}){{{low},{high}}}"
    raise TypeError(tree)


def regex(pattern: str) -> str:
    r"""A Java and RE2 regular expression for the whole text; \A and \z because $ lets a final line break pass."""
    return rf"\A(?:{_body(parse(pattern))})\z"


def prefix(tree: Tree) -> tuple[str, bool]:
    """The literal text every match starts with, and whether that is all of it."""
    match tree:
        case Chars(members):
            return (min(members), True) if len(members) == 1 else ("", False)
        case Sequence(parts):
            text = ""
            for p in parts:
                more, whole = prefix(p)
                text += more
                if not whole:
                    return text, False
            return text, True
        case Times(part, low, high):
            more, whole = prefix(part)
            return (more * low if whole else more if low else ""), whole and low == high
        case Choice(options):
            found = [prefix(o) for o in options]
            shared = min(t for t, _ in found)
            while not all(t.startswith(shared) for t, _ in found):
                shared = shared[:-1]
            return shared, len({t for t, _ in found}) == 1 and all(w for _, w in found)
    raise TypeError(tree)


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text fits the pattern.

    The prefix and the length bounds come first: a prefix reaches the scan as a
    pushed-down filter, which a regular expression cannot.
    """
    tree = parse(pattern)
    span, (start, _) = lengths(tree), prefix(tree)
    conditions = [text.startswith(start)] if start else []
    conditions += [F.char_length(text).between(span.low, span.high), text.rlike(regex(pattern))]
    return reduce(Column.__and__, conditions)
