"""A reproducible shuffle into shards: a keyed permutation of global row numbers.

Rows are numbered in the order of a hash of their values, so the numbers depend on the rows alone and
not on files, partitions or executors. A Feistel network permutes the numbers, walking its cycle until
it is back inside the table, and the permuted number gives shard and slot by division. Where a row
goes, and which number is at a given slot, can be computed without looking at any other row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heliograph.llm.common import written

ROUNDS = 6
BUCKET_BITS = 12
#: Repeated rows are unfolded in steps of this many.
STEP = 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, keyed."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Numbers below n, permuted within 0 .. n - 1. The same seed gives the same permutation."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int(k) for k in np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)]
    out = numbers.astype(np.uint64)
    left_out = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(left_out):
            left, right = out[left_out] >> half, out[left_out] & mask
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left, key) & mask), left
                else:
                    left, right = right, left ^ (_mix(right, key) & mask)
            out[left_out] = (left << half) | right
            left_out = left_out[out[left_out] >= n]
    return out.astype(np.int64)


def _permuted(n: int, seed: int) -> Callable:
    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return permuted


def number_rows(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Rows with a gapless number from 0, which depends on nothing but the rows.

    Equal rows are counted before the shuffle and unfolded after it, so a row repeated any number of
    times stays one row per task until the end. Buckets are ranges of the hash and therefore even.
    """
    value = F.xxhash64(*[F.col(c) for c in df.columns])
    counted = (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_hash", value)
        .withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKET_BITS).cast("int"))
    )
    counted = written(counted, "counted")
    # At most 2 ** BUCKET_BITS rows: one running sum, and small enough to broadcast at any input size.
    totals = counted.groupBy("_bucket").agg(F.sum("_n").alias("_total"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = (
        W.partitionBy("_bucket").orderBy("_hash", *df.columns).rowsBetween(W.unboundedPreceding, -1)
    )
    first = (
        counted.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_bucket")
        .withColumn("_first", F.col("_start") + F.col("_inside"))
    )
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / STEP)))
    in_steps = first.select(*df.columns, "_first", "_n", steps.alias("_step"))
    size = F.least(F.lit(STEP).cast("long"), F.col("_n") - F.col("_step") * STEP)
    each = F.explode(F.sequence(F.lit(0).cast("long"), size - 1))
    unfolded = in_steps.select(*df.columns, (F.col("_first") + F.col("_step") * STEP).alias("_first"), each.alias("_i"))
    return unfolded.select(*df.columns, (F.col("_first") + F.col("_i")).alias(name))


def feistel_shards(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Every row with its `row_number`, `shard` and `slot`: sizes of shards differ by one row at most,
    slots are gapless from 0 in each.

    Null values are values like any other; equal rows get numbers next to each other, which no result
    depends on; an empty table gives an empty result; a column of `df` may have any name except the
    three added ones and those that start with an underscore.
    """
    numbered = written(number_rows(df), "numbered")
    n = numbered.count()
    place = _permuted(max(n, 1), seed)(F.col("row_number"))
    return (
        numbered.withColumn("_place", place)
        .withColumn("shard", (F.col("_place") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / shards).cast("long"))
        .drop("_place")
    )
