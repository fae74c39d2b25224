"""Expressions that are used several times but found once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)
