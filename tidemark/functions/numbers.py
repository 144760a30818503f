"""Guarded arithmetic (ANSI mode raises on division by zero)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)
