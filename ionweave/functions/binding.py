"""A local name inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    An expression that a lambda mentions is evaluated again for every element; bound as a lambda variable it is not."""
    return F.get(F.transform(F.array(value), body), 0)
