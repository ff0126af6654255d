"""Columns that are expensive to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions run once per row, however often they are used after.

    Spark moves a filter below the projection that makes its column and writes the expression out at each
    use, nested ones again within each; what a generator makes stays where it is. Works on tables and streams.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
