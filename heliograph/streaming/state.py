"""What streams remember between micro-batches, as tables in the shared folder.

Both tables are written so that a micro-batch that runs again finds what the batch before it left and
overwrites its own part, and so that a batch opens only the part of the state that it can change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heliograph.sources.files import Commits, Files

#: Buckets of a new keyed table per shuffle partition of the session that makes it.
BUCKETS_PER_PARTITION = 4


def rows_of(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """No rows, with columns."""
    return spark.createDataFrame([], schema)


class KeyedState:
    """Rows by a key, kept in hash buckets.

    A micro-batch reads the buckets of its own keys and writes them anew under its number; all others
    stay where they are. A commit names the batch that each bucket was last written by, and files that
    neither of the last two commits names are removed: the table takes as many files as it has buckets,
    however many batches there were. The number of buckets is chosen when a table is made and stays with it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = rows_of(spark, schema).schema
        usual = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = Commits(spark, self.path).last().get("count", usual)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, *keys: DataFrame) -> list[int]:
        """Buckets of the keys in the first column of some tables: at most `buckets` numbers."""
        found = [df.select(self.bucket(df[df.columns[0]]).alias("b")).distinct() for df in keys]
        whole = found[0]
        for df in found[1:]:
            whole = whole.union(df)
        return sorted({r.b for r in whole.collect()})

    def read(self, touched: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some buckets or of all, after the last batch or after the one before a batch."""
        versions = Commits(self.spark, self.path).last(before).get("buckets", {})
        wanted = versions if touched is None else [str(b) for b in touched if str(b) in versions]
        paths = [f"{self.path}/version={versions[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else rows_of(self.spark, self.schema)

    def write(self, rows: DataFrame, touched: Sequence[int], batch_id: int) -> None:
        """Make `rows` all that the touched buckets hold from this batch on."""
        commits, files = Commits(self.spark, self.path), Files(self.spark, self.path)
        old, older = commits.last(batch_id).get("buckets", {}), {}
        if len(numbers := [n for n in commits.numbers() if n < batch_id]) > 1:
            older = commits.last(numbers[-1]).get("buckets", {})
        rows = rows.select(*self.schema.names, self.bucket(F.col(self.key)).alias("bucket"))
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={batch_id}")
        written = {n.removeprefix("bucket=") for n in files.names(f"version={batch_id}") if n.startswith("bucket=")}
        new = {b: v for b, v in old.items() if int(b) not in set(touched)} | dict.fromkeys(written, batch_id)
        commits.add(batch_id, {"count": self.buckets, "buckets": new})
        for b, v in older.items():
            if old.get(b) != v and new.get(b) != v:
                files.delete(f"version={v}/bucket={b}")
        for v in set(older.values()) - set(old.values()) - set(new.values()):
            files.delete(f"version={v}")

    def update(self, batch: DataFrame, keys: Sequence[DataFrame], batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Merge a batch into the buckets of its keys; returns what these held before."""
        touched = self.touched(*keys)
        before = self.read(touched, batch_id)
        self.write(merge(before, batch), touched, batch_id)
        return before


class TimedState:
    """Rows by the span of time they fall into, added to by every micro-batch and read by the span."""

    def __init__(self, spark: SparkSession, path: str, schema: str, at: str, span_seconds: int) -> None:
        self.spark, self.path, self.at, self.span_seconds = spark, path.rstrip("/"), at, span_seconds
        self.schema = rows_of(spark, schema).schema

    def span(self, at: Column) -> Column:
        return F.floor(F.unix_seconds(at) / self.span_seconds)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of one batch; a repetition replaces them."""
        placed = rows.select(*self.schema.names, self.span(F.col(self.at)).alias("span"), F.lit(batch_id).alias("batch"))
        writer = placed.hint("rebalance", "span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("span", "batch").parquet(self.path)

    def read(self, spans: Iterable[int], before: int) -> DataFrame:
        """Rows of some spans from the batches before one; no other folder is opened."""
        files = Files(self.spark, self.path)
        paths = []
        for span in sorted(set(spans)):
            own = [n for n in files.names(f"span={span}") if n.startswith("batch=")]
            paths += [f"{self.path}/span={span}/{n}" for n in own if int(n.removeprefix("batch=")) < before]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else rows_of(self.spark, self.schema)


class SeenIds:
    """All ids that a stream has had, in segments by arrival, each with Bloom bits.

    The ids of a batch are looked up in the bits, a word of 64 per id and size of segment, and only where all
    bits of an id are set in a segment is that segment's list opened for an exact answer: an id is new or not for
    certain, however late it comes. Nothing is held in memory between batches. Segments of one level are merged
    into one of the next as soon as there are `fanout`, so their number grows with the logarithm of the batches.
    """

    BITS = "segment STRING, e INT, word BIGINT, bits BIGINT"
    LISTED = "segment STRING, key STRING"

    def __init__(self, spark: SparkSession, path: str, fanout: int = 8) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    def segments(self, before: int | None = None) -> list[dict]:
        """Name, level and size (as a power of two) of each segment."""
        return Commits(self.spark, self.path).last(before).get("segments", [])

    @staticmethod
    def _word(e: Column) -> Column:
        return F.xxhash64("key").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), e) - 1)

    @staticmethod
    def _mask() -> Column:
        spots, mask = F.xxhash64("key", F.lit(1)), F.lit(0).cast("long")
        for k in range(4):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spots, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
        return mask

    def _read(self, kind: str, names: Sequence[str]) -> DataFrame:
        schema = self.BITS if kind == "bits" else self.LISTED
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def _write(self, keys: DataFrame, name: str, level: int) -> dict:
        listed = keys.select(F.lit(name).alias("segment"), "key")
        listed.write.mode("overwrite").parquet(f"{self.path}/list/{name}")
        # Sixteen bits per id: about one id in four hundred is looked up in vain.
        e = max(4, (self._read("list", [name]).count() // 4).bit_length())
        bits = self._read("list", [name]).groupBy("segment", F.lit(e).alias("e"), self._word(F.lit(e)).alias("word")).agg(F.bit_or(self._mask()).alias("bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/bits/{name}")
        return {"name": name, "level": level, "e": e}

    def _likely(self, keys: DataFrame, segments: list[dict]) -> DataFrame:
        """(segment, key) wherever all bits of a key are set."""
        if not segments:
            return rows_of(self.spark, self.LISTED)
        sizes = F.array(*[F.lit(e) for e in sorted({s["e"] for s in segments})])
        asked = keys.select("key", F.explode(sizes).alias("e")).withColumn("word", self._word(F.col("e"))).withColumn("mask", self._mask())
        found = asked.join(self._read("bits", [s["name"] for s in segments]), ["e", "word"])
        return found.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("segment", "key")

    def admit(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Of the `key` values of a batch those that no batch before had, once each. A repeated batch gives the same."""
        commits, keys = Commits(self.spark, self.path), keys.select("key").distinct()
        segments, name = self.segments(batch_id), f"0-{batch_id}"
        likely = self._likely(keys, segments).persist()
        try:
            # One name per segment.
            opened = sorted(r.segment for r in likely.select("segment").distinct().collect())
            if opened:
                seen = likely.join(self._read("list", opened), ["segment", "key"], "left_semi")
                keys = keys.join(seen.select("key").distinct(), "key", "left_anti")
            segments.append(self._write(keys, name, 0))
        finally:
            likely.unpersist()
        level = 0
        while len(own := [s for s in segments if s["level"] == level]) >= self.fanout:
            level += 1
            whole = self._write(self._read("list", [s["name"] for s in own]), f"{level}-{batch_id}", level)
            segments = [s for s in segments if s["level"] != level - 1] + [whole]
        before = {s["name"] for s in self.segments(batch_id)}
        commits.add(batch_id, {"segments": segments})
        files, kept = Files(self.spark, self.path), before | {s["name"] for s in segments} | {name}
        for kind in ("list", "bits"):
            for old in set(files.names(kind)) - kept:
                files.delete(f"{kind}/{old}")
        return self._read("list", [name]).select("key")
