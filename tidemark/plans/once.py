"""Evaluate an expensive expression once per row, however often its result is used.

The optimizer inlines a projected expression into every later filter and projection that mentions it,
and turns each access to a field of a parsed JSON value into a parse of its own. A one-element
``inline`` is a boundary it does not move expressions across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the named columns added, each computed exactly once per row."""
    fields = [expr.alias(name) for name, expr in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*fields))))
