"""Helpers for building Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written and worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def some(*cs: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(F.get(F.filter(F.array(*cs), lambda x: x != ""), F.lit(0)), F.lit(""))
