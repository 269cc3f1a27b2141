"""Constrained decoding against all alignments; greedy decoding; line readings."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from lectern.catalog import Catalog, Kind
from lectern.grammar import compile_pattern
from lectern.operators import decode
from lectern.operators.decode import all_kinds, beam_search, constrained, greedy


def collapse(path, classes):
    return "".join(classes[c] for c, _ in itertools.groupby(path) if c)


def everything(matrix, classes, automaton, gap):
    out = {}
    for path in itertools.product(range(len(classes)), repeat=len(matrix)):
        p = float(np.prod([row[c] for row, c in zip(matrix, path, strict=True)]))
        if gap:
            path = [0 if classes[c] == " " else c for c in path]
        text = collapse(path, classes)
        if automaton.matches(text):
            out[text] = out.get(text, 0) + p
    return {t: p for t, p in out.items() if p > 0}


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize(("classes", "pattern"), [(["", "6", "7", "9"], "[679]{2,3}"), (["", "6", "7", " "], "[67]{2,3}")])
def test_beam_equals_all_alignments(seed, classes, pattern):
    matrix = np.random.default_rng(seed).dirichlet([0.6] * 4, 6)
    a = compile_pattern(pattern)
    found = dict(beam_search(matrix.tolist(), classes, a, beam=256, least=0.0))
    expected = everything(matrix, classes, a, " " in classes)
    assert found.keys() == expected.keys()
    assert all(abs(found[t] - p) < 1e-9 for t, p in expected.items())


CLASSES = ["", *"0123456789GJOAB-", " "]


def spell(text, sure=0.9):
    rows = []
    for c in text:
        row = [0.0] * len(CLASSES)
        row[CLASSES.index(c) if c != "_" else 0] = sure
        row[0] += 1 - sure
        rows += [row, [1.0] + [0.0] * (len(CLASSES) - 1)]
    return rows


@pytest.mark.parametrize(("written", "pattern", "read"), [("GJ07966", r"GJ\d{5}", "GJ07966"), ("GJ 07966", r"GJ\d{5}", "GJ07966"), ("AB 123", r"AB \d{3}", "AB 123"), ("GJ07766", r"GJ\d{5}", "GJ07766"), ("AB", r"GJ\d{5}", None)])
def test_goldens(written, pattern, read, spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(spell(written),), (None,)], "probs array<array<double>>")
    got = frame.select(constrained(F.col("probs"), CLASSES, compile_pattern(pattern)).alias("r"), greedy(F.col("probs"), CLASSES).alias("g")).collect()
    assert [x["text"] for x in got[0]["r"][:1]] == ([read] if read else [])
    assert got[0]["g"]["text"] == written and got[1]["r"] is None


def test_the_grammar_overrules_a_likelier_letter():
    rows = spell("AB-128")
    at = CLASSES.index("8")
    for r in rows:
        if r[at]:
            r[at], r[CLASSES.index("B")] = 0.35, 0.55
    found = beam_search(rows, CLASSES, compile_pattern(r"AB-\d{3}"))
    assert found[0][0] == "AB-128" and "AB-12B" not in dict(found)


def test_batches_equal_single_matrices(spark):
    """Matrices of any length, empty and null ones, and several kinds, decoded together."""
    from pyspark.sql import functions as F

    rng, catalog = np.random.default_rng(5), Catalog("c", (Kind("short", "[67]{1,2}"), Kind("long", "[679]{2,4}")))
    classes = ["", "6", "7", "9"]
    matrices = [rng.dirichlet([0.6] * 4, int(n)).tolist() for n in rng.integers(1, 12, 60)] + [[], None]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(matrices)], "i int, probs array<array<double>>").repartition(2)
    got = {r["i"]: r["found"] for r in frame.select("i", all_kinds(F.col("probs"), classes, catalog, beam=4).alias("found")).collect()}
    for i, m in enumerate(matrices):
        want = [] if m is None else [(t, p, k.tag_id, j) for j, k in enumerate(catalog.kinds) for t, p in beam_search(m, classes, k.automaton, beam=4)[:3]]
        assert [tuple(r) for r in got[i]] == want


@pytest.mark.parametrize("beam", [1, 2, 5])
def test_a_narrow_beam_finds_no_more_than_there_is(beam):
    a = compile_pattern("[679]{1,4}")
    for seed in range(20):
        matrix = np.random.default_rng(seed).dirichlet([0.6] * 4, 7).tolist()
        classes = ["", "6", "7", "9"]
        wide, narrow = dict(beam_search(matrix, classes, a, 500, 0.0)), beam_search(matrix, classes, a, beam, 0.0)
        assert len(narrow) <= beam and all(p <= wide[t] + 1e-12 for t, p in narrow) and [p for _, p in narrow] == sorted((p for _, p in narrow), reverse=True)


def test_batches_are_read_in_bounded_pieces(monkeypatch):
    """Pieces hold at most ROWS matrices and VALUES probabilities, whatever the batch and its matrices; the readings are those of each matrix alone."""
    rng, automaton = np.random.default_rng(3), compile_pattern("[679]{1,3}")
    made = [None if i % 7 == 3 else rng.dirichlet(np.ones(4), 40 if i % 5 == 0 else i % 4).tolist() for i in range(60)]
    monkeypatch.setattr(decode, "ROWS", 4)
    monkeypatch.setattr(decode, "VALUES", 100)
    seen = []

    def read(matrices):
        seen.append((len(matrices.steps), int(np.maximum(matrices.steps, 0).sum()) * 4))
        return [None if f is None else [t for t, _ in f] for f in decode.search(matrices, decode.Machine(automaton, ["", "6", "7", "9"]))]

    column = pa.array([None, *made], pa.list_(pa.list_(pa.float64()))).slice(1)
    got = decode.in_pieces(column, 4, pa.list_(pa.string()), read).to_pylist()
    assert got == [None if m is None else [t for t, _ in decode.beam_search(np.reshape(m, (-1, 4)), ["", "6", "7", "9"], automaton)] for m in made]
    assert sum(n for n, _ in seen) == 60 and all(n <= 4 and (v <= 100 or n == 1) for n, v in seen)
    assert decode.in_pieces(column.slice(0, 0), 4, pa.list_(pa.string()), read).to_pylist() == []
