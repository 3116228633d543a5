"""Null ids on their way through pandas, where a null would turn ids into floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = -(1 << 63)


def filled(name: str) -> Column:
    """The id as a long; the least long stands for null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NONE)).alias(name)


def emptied(name: str) -> Column:
    """Null again."""
    return F.when(F.col(name) != NONE, F.col(name)).alias(name)
