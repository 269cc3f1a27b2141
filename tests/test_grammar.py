"""Grammar: golden vectors, a differential test against re, minimality."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from lectern.grammar import MESSAGES, PatternError, build, compile_pattern, parse, regex

VALID = [
    (r"MD\d{5}", 7, 7, 8), (r"[A-Z]{2}-\d{3,4}", 6, 7, 8), (r"(MD|NHM)\d{5}", 7, 8, 10), (r"MD\d{5}|NHM\d{4}", 7, 7, 10),
    (r"[A-Z]{1,4} \d{1,6}(\.\d{1,2}){0,1}", 3, 14, 15), ("[-a]", 1, 1, 2), ("[a-]", 1, 1, 2), (r"[a\-z]", 1, 1, 2), ("[x^]", 1, 1, 2),
    (r"[\]\[\\]", 1, 1, 2), (r"[\dA-F]{2}", 2, 2, 3), ("Ré-é", 4, 4, 5), ("a|ab|abc", 1, 3, 4), ("(a|ab)(c|bcd)", 2, 5, 7),
    ("((a|b){2}|c){1,2}", 1, 4, 5), ("x{64}", 64, 64, 65), ("(x{64}){4}", 256, 256, 257), ("a{0,1}b", 1, 2, 3), ("A B", 3, 3, 4),
]
INVALID = [
    ("", "empty_pattern", 0), ("a{0,1}", "matches_empty", 0), ("(a|b{0,3}){1,2}", "matches_empty", 0), ("(x{64}){5}", "too_long", 0),
    ("(a", "unbalanced_paren", 0), ("a)", "unbalanced_paren", 1), (")", "unbalanced_paren", 0), ("((a)", "unbalanced_paren", 0),
    ("[ab", "unbalanced_bracket", 0), ("a{2", "unbalanced_brace", 1), ("()", "empty_group", 1), ("(a|)", "empty_alternative", 3),
    ("|a", "empty_alternative", 0), ("a|", "empty_alternative", 2), ("[]", "empty_class", 1), ("(" * 17 + "a" + ")" * 17, "nested_too_deep", 16),
    (r"MD\d+", "unbounded_quantifier", 4), ("a*", "unbounded_quantifier", 1), ("a{3,}", "unbounded_quantifier", 1), ("a?", "unsupported_quantifier", 1),
    ("{2}", "invalid_quantifier", 0), ("a{x}", "invalid_quantifier", 1), ("a{,3}", "invalid_quantifier", 1), ("a{ 2}", "invalid_quantifier", 1),
    ("a{3,2}", "invalid_quantifier", 1), ("a{0}", "invalid_quantifier", 1), ("a{2}{3}", "invalid_quantifier", 4), ("a{2}+", "invalid_quantifier", 4),
    ("a{65}", "repeat_too_large", 1), ("^MD", "anchor", 0), ("MD$", "anchor", 2), ("M.", "wildcard", 1), ("a]", "unescaped_special", 1),
    ("a}", "unescaped_special", 1), ("[a[]", "unescaped_special", 2), ("(?:a)", "group_extension", 1), (r"\w", "unsupported_escape", 0),
    (r"[\s]", "unsupported_escape", 1), ("ab\\", "unsupported_escape", 2), (r"(a)\1", "backreference", 3), ("[^a]", "negated_class", 1),
    ("[z-a]", "invalid_range", 1), (r"[\d-z]", "invalid_range", 1), (r"[a-\d]", "invalid_range", 3), ("[ -ʠ]", "class_too_large", 1),
    ("[Ā-ǿȀ-˿a]", "class_too_large", 0), ("a\u0007", "control_character", 1), ("[~-¡]", "control_character", 1),
]


@pytest.mark.parametrize(("pattern", "low", "high", "states"), VALID)
def test_valid(pattern, low, high, states):
    a = compile_pattern(pattern)
    assert (a.span.low, a.span.high, len(a.steps)) == (low, high, states)


@pytest.mark.parametrize(("pattern", "code", "position"), INVALID)
def test_invalid(pattern, code, position):
    with pytest.raises(PatternError) as e:
        compile_pattern(pattern)
    assert (e.value.code, e.value.position) == (code, position)
    assert MESSAGES[code] in str(e.value) and e.value.at("tags[0].pattern").location == "tags[0].pattern"


def test_limits_and_types():
    with pytest.raises(TypeError):
        parse(5)
    with pytest.raises(PatternError, match="too_complex"):
        build(parse("abcdef"), "abcdef", max_states=3)


def _random_pattern(rng: random.Random, depth: int = 0) -> str:
    def atom() -> str:
        kind = rng.randrange(4 if depth < 2 else 3)
        return rng.choice("abc") if kind == 0 else rng.choice(["[ab]", "[b-c]", "[ac]"]) if kind == 1 else rng.choice("ab") if kind == 2 else f"({_random_pattern(rng, depth + 1)})"

    def part() -> str:
        return atom() + rng.choice(["", "", "", "{2}", "{0,1}", "{1,2}"])

    return "|".join("".join(part() for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 1, 2])))


def _language(a) -> set[str]:
    out, todo = set(), [("", 0)]
    while todo:
        text, state = todo.pop()
        if state in a.accepting:
            out.add(text)
        todo += [(text + c, t) for c, t in a.steps[state].items()]
    return out


def test_differential_against_re_and_minimal():
    rng, done = random.Random(20261006), 0
    while done < 300:
        pattern = _random_pattern(rng)
        try:
            a = compile_pattern(pattern)
        except PatternError as e:
            assert e.code in ("matches_empty", "too_long")
            continue
        done += 1
        if a.span.high > 7:
            continue
        compiled = re.compile(pattern.replace("(", "(?:"))
        words = {"".join(w) for n in range(a.span.high + 1) for w in itertools.product("abc", repeat=n)}
        expected = {w for w in words if compiled.fullmatch(w)}
        assert _language(a) == expected
        emitted = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), regex(pattern)).replace(r"\z", r"\Z"))
        assert {w for w in words if emitted.search(w)} == expected
        prefixes = {w[:k] for w in expected for k in range(len(w) + 1)}
        assert len(a.steps) == len({frozenset(w[len(p) :] for w in expected if w.startswith(p)) for p in prefixes})


@pytest.mark.parametrize(("one", "two"), [("ab|ac", "a[bc]"), ("a{2}", "aa"), ("(a|b){2}", "[ab]{2}"), ("a{1,2}", "a|aa"), (r"\d", "[0-9]"), ("(ab){0,1}c", "abc|c"), ("a(b|c)|ad", "a[b-d]")])
def test_equal_languages_equal_automata(one, two):
    assert compile_pattern(one) == compile_pattern(two)
