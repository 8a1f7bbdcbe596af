"""Values that an expression uses several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once: inside lambdas, Spark evaluates each mention of an expression anew."""
    return F.get(F.transform(F.array(value), use), 0)
