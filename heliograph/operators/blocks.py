"""Ordered blocks of the rows of a key, for windows over keys that may hold most of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a block, about.
MOST_ROWS = 65_536
_PARTS = 1 << 20


def time_blocks(rows: DataFrame, key: str, at: str, seconds: int, most: int = MOST_ROWS, name: str = "_block") -> DataFrame:
    """Rows with the number of their block: blocks of a key follow each other in time.

    A block is a span of `seconds` of one key. A span that holds more than `most` rows is cut between
    seconds into parts of about that many. Rows are counted per second, which combines before the shuffle,
    and the running sum goes over one row per second of a span.
    """
    span, second = F.floor(F.unix_seconds(at) / seconds), F.unix_seconds(at)
    placed = rows.withColumn("_span", span).withColumn("_second", second)
    counts = placed.groupBy(key, "_span", "_second").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key, "_span").orderBy("_second").rowsBetween(W.unboundedPreceding, -1)
    part = F.least(F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / most), F.lit(_PARTS - 1))
    # Only seconds behind a cut are looked up; nearly always there are none.
    cut = counts.withColumn("_part", part).filter("_part > 0")
    cut = cut.select(F.col(key).alias("_key"), F.col("_second").alias("_at"), "_part")
    same = (F.col(key) == F.col("_key")) & (F.col("_second") == F.col("_at"))
    block = F.col("_span") * _PARTS + F.coalesce("_part", F.lit(0))
    return placed.join(cut, same, "left").withColumn(name, block).drop("_span", "_second", "_key", "_at", "_part")
