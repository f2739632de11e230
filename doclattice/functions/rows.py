"""Turning arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, pos: str, value: str) -> DataFrame:
    """One row per array element with its position; empty and NULL arrays give none.

    Same rows as ``posexplode``. For a plain explode the optimizer adds ``size(array) > 0 and array
    is not null`` below it, and so computes a costly array expression three times; the outer form
    with a filter above computes it once.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(
        F.col(pos).isNotNull()
    )
