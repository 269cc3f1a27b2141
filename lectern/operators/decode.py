"""Decoding recogniser probabilities: freely in expressions, under a grammar in an Arrow UDF over whole batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.grammar import Automaton

BEAM, MIN_PROBABILITY = 16, 1e-4
#: Cells (matrices times candidates) that a step works on at once.
CELLS = 1 << 19
#: Matrices of an Arrow batch, and their probabilities, that are unpacked and read at once.
ROWS, VALUES = 1024, 1 << 18
_HASH = np.uint64(0x9E3779B97F4A7C15)
READINGS = "array<struct<text:string,probability:double>>"


def greedy(probs: Column, classes: Sequence[str]) -> Column:
    """struct<text, probability> of the best class of each step: repeats and blanks (class 0) go.

    Of equal probabilities the first class counts.
    """
    best = F.transform(probs, lambda row: F.array_position(row, F.array_max(row)).cast("int"))
    kept = F.filter(best, lambda c, i: (c > 1) & ((i == 0) | (c != F.get(best, i - 1))))
    names = F.array(*map(F.lit, classes))
    text = F.array_join(F.transform(kept, lambda c: F.element_at(names, c)), "")
    probability = F.aggregate(probs, F.lit(1.0), lambda p, row: p * F.array_max(row))
    return F.struct(text.alias("text"), probability.cast("double").alias("probability"))


@dataclass(frozen=True)
class Dense:
    """Matrices of a batch as one array (rows, steps, classes), with the steps of each; -1 stands for no matrix."""

    values: np.ndarray
    steps: np.ndarray


def dense(column: pa.Array, classes: int) -> Dense:
    """The matrices of an array<array<double>> column."""
    steps = column.value_lengths().to_numpy(zero_copy_only=False)
    steps = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.nan_to_num(steps), -1).astype(np.int64)
    size = np.maximum(steps, 0)
    out = np.zeros((len(column), int(size.max(initial=0)), classes))
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False)
    if len(flat) != size.sum() * classes:
        raise ValueError(f"every step needs {classes} probabilities")
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.reshape(-1, classes)
    return Dense(out, steps)


class Machine:
    """An automaton as tables over the characters that classes can write: next states (-1: none), classes, where a space is no character."""

    def __init__(self, automaton: Automaton, classes: Sequence[str]) -> None:
        place = {c: i for i, c in enumerate(classes) if i}
        self.characters = [c for c in sorted(automaton.alphabet) if c in place]
        self.column = np.array([place[c] for c in self.characters], np.int64)
        self.next = np.array([[s.get(c, -1) for c in self.characters] for s in automaton.steps], np.int64).reshape(len(automaton.steps), -1)
        self.accepts = np.array([i in automaton.accepting for i in range(len(automaton.steps))])
        self.space = place.get(" ", 0)
        self.blank_space = np.array([" " not in s for s in automaton.steps]) if self.space else np.zeros(len(automaton.steps), bool)


def search(matrices: Dense, machine: Machine, beam: int = BEAM, least: float = MIN_PROBABILITY) -> list[list[tuple[str, float]] | None]:
    """For each matrix the texts of the language with the probability of all their alignments, best first; None where there is no matrix.

    Every row holds up to beam prefixes, each with the mass of alignments that end in
    a blank and of those that end in its last character. Only characters that the
    automaton allows extend a prefix; a space it does not allow counts as a blank.
    Ties keep the order in which prefixes came up, with characters in sorted order.
    """
    kinds, order = len(machine.characters), np.argsort(-matrices.steps, kind="stable")
    out: list[list[tuple[str, float]] | None] = [None if n < 0 else [] for n in matrices.steps]
    chunk = max(1, CELLS // (beam * (kinds + 1)))
    for lo in range(0, len(order), chunk):
        at = order[lo : lo + chunk]
        for i, found in zip(at.tolist(), _run(matrices.values[at], np.maximum(matrices.steps[at], 0), machine, beam, least), strict=True):
            if out[i] is not None:
                out[i] = found
    return out


def _run(values: np.ndarray, steps: np.ndarray, m: Machine, beam: int, least: float) -> list[list[tuple[str, float]]]:
    """search() over rows whose steps fall, all rows and prefixes of a step at once."""
    n, kinds = len(values), len(m.characters)
    wide, spots = kinds + 1, np.arange(beam)
    # a slot of the beam: masses, state, last character (-1: none), a hash of the prefix and of the one before its last character
    mass = np.zeros((n, beam, 2))
    mass[:, 0, 0] = 1.0
    state, last = np.zeros((n, beam), np.int64), np.full((n, beam), -1)
    own, shorter = np.ones((n, beam), np.uint64), np.zeros((n, beam), np.uint64)
    used = np.zeros((n, beam), bool)
    used[:, 0] = True
    trail = []
    for t in range(int(steps.max(initial=0))):
        k = int(np.searchsorted(-steps, -t, "left"))  # rows that have a step t
        p, all_ = values[:k, t], mass[:k].sum(axis=2)
        pause = p[:, :1] + np.where(m.blank_space[state[:k]], p[:, m.space, None], 0.0) if m.space else np.repeat(p[:, :1], beam, axis=1)
        letters = p[:, m.column] if kinds else np.zeros((k, 0))
        again = np.where(last[:k] >= 0, np.take_along_axis(letters, np.maximum(last[:k], 0), axis=1), 0.0) if kinds else np.zeros((k, beam))
        grown = np.zeros((k, beam, wide, 2))
        grown[:, :, 0, 0], grown[:, :, 0, 1] = all_ * pause, mass[:k, :, 1] * again
        target = m.next[state[:k]]
        open_ = used[:k, :, None] & (target >= 0) & ((letters > 0) & (letters >= least))[:, None, :]
        repeats = last[:k, :, None] == np.arange(kinds)
        grown[:, :, 1:, 1] = np.where(open_, np.where(repeats, mass[:k, :, :1], all_[:, :, None]) * letters[:, None, :], 0.0)
        live = np.concatenate([used[:k, :, None], open_], axis=2)
        # a slot whose last character extends another slot's prefix is the same prefix: the earlier place takes both masses
        row, child, parent = np.nonzero((shorter[:k, :, None] == own[:k, None, :]) & used[:k, :, None] & used[:k, None, :])
        letter = last[row, child] + 1
        here = live[row, parent, letter]
        row, child, parent, letter = row[here], child[here], parent[here], letter[here]
        both = grown[row, child, 0] + grown[row, parent, letter]
        first = parent * wide + letter < child * wide
        keep = np.where(first, parent, child), np.where(first, letter, 0)
        drop = np.where(first, child, parent), np.where(first, 0, letter)
        grown[row, keep[0], keep[1]] = both
        live[row, drop[0], drop[1]] = False
        total = np.where(live, grown.sum(axis=3), -1.0).reshape(k, -1)
        live = live.reshape(k, -1)
        many = live.sum(axis=1) > beam
        pick = np.argsort(np.where(many[:, None], -total, ~live), axis=1, kind="stable")[:, :beam]
        slot, letter = pick // wide, pick % wide
        new = lambda x: np.take_along_axis(x.reshape(k, -1), pick, axis=1)
        old = lambda x: np.take_along_axis(x[:k], slot, axis=1)
        was_last, was_shorter, was_state = old(last), old(shorter), old(state)
        extended = letter > 0
        was_own = old(own)
        own[:k] = np.where(extended, was_own * _HASH + letter.astype(np.uint64), was_own)
        shorter[:k] = np.where(extended, was_own, was_shorter)
        state[:k] = np.where(extended, np.take_along_axis(m.next[was_state], np.maximum(letter - 1, 0)[:, :, None], axis=2)[:, :, 0] if kinds else was_state, was_state)
        last[:k] = np.where(extended, letter - 1, was_last)
        used[:k] = new(live)
        mass[:k] = np.where(used[:k, :, None], np.stack([new(grown[..., 0].copy()), new(grown[..., 1].copy())], axis=2), 0.0)
        trail.append((np.concatenate([slot, np.tile(spots, (n - k, 1))]), np.concatenate([letter, np.zeros((n - k, beam), np.int64)])))
    total = np.where(used & m.accepts[state], mass.sum(axis=2), 0.0)
    ranked = np.argsort(-total, axis=1, kind="stable")
    ends = np.count_nonzero(total > 0, axis=1)
    written, at = [], np.tile(spots, (n, 1))
    for slot, letter in reversed(trail):
        written.append(np.take_along_axis(letter, at, axis=1))
        at = np.take_along_axis(slot, at, axis=1)
    spelled = np.stack(written[::-1], axis=2) if written else np.zeros((n, beam, 0), np.int64)
    names = ["", *m.characters]
    return [[("".join([names[c] for c in spelled[i, j].tolist()]), float(total[i, j])) for j in ranked[i, : ends[i]].tolist()] for i in range(n)]


def beam_search(rows: Sequence[Sequence[float]], classes: Sequence[str], automaton: Automaton, beam: int = BEAM, least: float = MIN_PROBABILITY) -> list[tuple[str, float]]:
    """search() over one matrix."""
    values = np.array(rows, float).reshape(1, len(rows), len(classes))
    return search(Dense(values, np.array([len(rows)])), Machine(automaton, classes), beam, least)[0] or []


def in_pieces(column: pa.Array, classes: int, kind: pa.DataType, read: Callable[[Dense], list]) -> pa.Array:
    """read() over a column of matrices, a bounded piece at a time, so that memory follows neither the batch nor the size of its matrices; a matrix of more than VALUES is a piece of its own."""
    size = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)) * classes)
    done, lo = [pa.array([], kind)], 0
    while lo < len(column):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + VALUES, "right"))
        hi = min(max(hi, lo + 1), lo + ROWS)
        done.append(pa.array(read(dense(column.slice(lo, hi - lo), classes)), kind))
        lo = hi
    return pa.concat_arrays(done)


def constrained(probs: Column, classes: Sequence[str], automaton: Automaton, beam: int = BEAM, least: float = MIN_PROBABILITY, top: int | None = None) -> Column:
    """search() over a column array<array<double>>, as array<struct<text, probability>>; null rows give null."""

    @F.arrow_udf(READINGS)
    def run(column: pa.Array) -> pa.Array:
        machine = Machine(automaton, classes)

        def read(matrices: Dense) -> list:
            return [None if f is None else [{"text": t, "probability": p} for t, p in f[:top]] for f in search(matrices, machine, beam, least)]

        return in_pieces(column, len(classes), pa.list_(pa.struct([("text", pa.string()), ("probability", pa.float64())])), read)

    return run(probs)


def all_kinds(probs: Column, classes: Sequence[str], catalog: Catalog, beam: int = BEAM, least: float = MIN_PROBABILITY, top: int = 3) -> Column:
    """array<struct<text, probability, tag_id, kind_ord>>: the top readings under each kind, kinds in order; each matrix is unpacked once for all kinds."""

    @F.arrow_udf("array<struct<text:string,probability:double,tag_id:string,kind_ord:int>>")
    def run(column: pa.Array) -> pa.Array:
        machines = [Machine(kind.automaton, classes) for kind in catalog.kinds]

        def read(matrices: Dense) -> list:
            out: list[list[dict]] = [[] for _ in range(len(matrices.steps))]
            for i, (kind, machine) in enumerate(zip(catalog.kinds, machines, strict=True)):
                for to, found in zip(out, search(matrices, machine, beam, least), strict=True):
                    to += [{"text": t, "probability": p, "tag_id": kind.tag_id, "kind_ord": i} for t, p in (found or [])[:top]]
            return out

        return in_pieces(column, len(classes), pa.list_(pa.struct([("text", pa.string()), ("probability", pa.float64()), ("tag_id", pa.string()), ("kind_ord", pa.int32())])), read)

    return run(probs)
