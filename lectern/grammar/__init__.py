"""The finite pattern grammar: parsing, automata and column expressions."""

from lectern.grammar.automaton import Automaton, build, compile_pattern
from lectern.grammar.emit import matches, regex
from lectern.grammar.syntax import MESSAGES, PatternError, parse

__all__ = ["MESSAGES", "Automaton", "PatternError", "build", "compile_pattern", "matches", "parse", "regex"]
