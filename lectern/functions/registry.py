"""The engine's rules for SQL text: temporary functions and a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern import grammar
from lectern.catalog import Catalog


@udtf(returnType="pattern string, code string, message string, position int, min_length int, max_length int, states int")
class PatternDiagnostics:
    """One row about a pattern: its first fault, or its lengths and number of states."""

    def eval(self, pattern: str) -> Iterator[tuple]:
        try:
            a = grammar.compile_pattern(pattern)
            yield pattern, None, None, None, a.span.low, a.span.high, len(a.steps)
        except grammar.PatternError as e:
            yield pattern, e.code, grammar.MESSAGES[e.code], e.position, None, None, None


def _case(catalog: Catalog) -> str:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    arms = " ".join(f"WHEN text RLIKE {quote(grammar.regex(k.pattern))} THEN {quote(k.tag_id)}" for k in catalog.kinds)
    return f"CASE {arms} END" if arms else "CAST(NULL AS STRING)"


def register(spark: SparkSession, catalog: Catalog) -> None:
    """match_kind(text) for a catalog, status(confidence), and pattern_diagnostics(pattern) for spark.sql()."""
    spark.udtf.register("pattern_diagnostics", PatternDiagnostics)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION match_kind(text STRING) RETURNS STRING RETURN {_case(catalog)}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reading_status(confidence DOUBLE) RETURNS STRING RETURN CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence >= 0.25 THEN 'review' ELSE 'unreadable' END")
