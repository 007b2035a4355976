"""Bind a value once inside a column expression.

Columns that are read several times would otherwise be copied into every use, and
predicate pushdown multiplies the copies; a bound value stays one expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
