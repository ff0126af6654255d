"""Newest-first lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Default lengths of the lists.
LIST_LIMITS = {"activity": 100, "sessions": 50, "leads": 500, "emails": 500, "replies": 200}


# Into how many slices the tasks are sorted before their top rows meet.
MERGE_SLICES = 256


def newest_first(df: DataFrame, ts: str, limit: int | None, tie: str = "id") -> DataFrame:
    """The newest rows; with a limit each task keeps only its own top rows."""
    ordered = df.orderBy(F.col(ts).desc_nulls_last(), tie)
    return ordered if limit is None else ordered.limit(limit)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, with their place in `_rn`.

    Spark cuts the rows of every task to n per group before a shuffle (WindowGroupLimit). What is
    left of a group with rows in very many tasks is cut once more in slices of tasks before the
    group comes together, so no task sees more than n rows from each slice.
    """
    slices = df.withColumn("_slice", F.spark_partition_id() % MERGE_SLICES)
    in_slice = W.partitionBy(*keys, "_slice").orderBy(*order)
    in_group = W.partitionBy(*keys).orderBy(*order)
    return (
        slices.withColumn("_rn", F.row_number().over(in_slice))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(in_group))
        .filter(F.col("_rn") <= n)
        .drop("_slice")
    )


def newest_per_group(df: DataFrame, key: str, n: int, ts: str, tie: str = "id") -> DataFrame:
    """The newest n rows of each group."""
    return top_per_group(df, [key], [F.col(ts).desc_nulls_last(), tie], n).drop("_rn")
