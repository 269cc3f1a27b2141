"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once.

    Used wherever a derived value is looked at often: without it each use repeats
    the whole expression, and nested rules grow past what the planner can take.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
