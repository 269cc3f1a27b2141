"""The driver's contract."""

from __future__ import annotations

import os

import __spark_entry__ as entry


def test_names_and_sql():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "e6_metrics" in names
    if os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "lectern", "llm")):
        assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["photos"] > 0 and 0 < row["exact_match_rate"] < 1
