"""What several operators share: tables, written intermediate results, state of a Python worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back, which cuts its lineage: a
    lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written intermediate results of one operator by name, dropped when their successors are written."""

    def __init__(self, spark: SparkSession, prefix: str) -> None:
        self.spark, self.prefix = spark, prefix
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As `written`."""
        self.paths[name] = path = scratch_path(self.spark, f"{self.prefix}-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete results that nothing reads any more; names without one are passed over."""
        jvm = self.spark._jvm
        for path in filter(None, (self.paths.pop(name, None) for name in names)):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """Let Spark hand rows with texts to Python in batches of few megabytes: a batch stands in memory of
    the executor and of its worker at the same time, and its buffers are kept for the next one. Returns the
    rows as they are; the settings are those of the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that isn't among those given, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(text, UPPER, LOWER)


def text_key(*columns: Column) -> Column:
    """A 64-bit hash that tells rows with equal ids but different texts apart."""
    return F.xxhash64(*columns)


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """Something made once per Python worker and kept over its tasks, such as a loaded tokenizer."""
    holder = sys.modules.setdefault("_heliograph_worker", types.ModuleType("_heliograph_worker"))
    if not hasattr(holder, key):
        setattr(holder, key, make())
    return getattr(holder, key)


def leaving_nothing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches whose worker keeps no memory of it, nor state of other operators before it.

    Workers stay for a while after their tasks, and what they hold counts beside the executor's own memory in the stages
    that follow. Freed memory goes back to the system only when it is asked for.
    """
    def wrapped(batches: Iterator) -> Iterator:
        import ctypes
        import gc
        import sys

        import pyarrow as pa

        def release() -> None:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

        libc = ctypes.CDLL(None)
        if sys.modules.pop("_heliograph_worker", None) is not None:
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def _slot(value: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(size))


def member_bits(values: DataFrame, column: str, size: int) -> Column:
    """A bit array of `size` bits, one set for each value of a column, to be used in other queries as one
    value of a fixed size."""
    slot = _slot(F.col(column), size)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    parts = values.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    # As many rows as the array has parts: a fixed number.
    every = values.sparkSession.range(size // 64).join(parts, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(listed, lambda p: p["bits"]).alias("bits")).scalar()


def may_be_member(value: Column, bits: Column, size: int) -> Column:
    """Whether a value's bit is set: always so for members, by chance for others."""
    slot = _slot(value, size)
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1
