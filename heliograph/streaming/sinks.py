"""Writing streams to tables and reading the current state back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from heliograph.session import scratch_path
from heliograph.sources.files import Commits, Files


#: Batches after which they are merged into one table.
MERGED_AFTER = 16

Merge = Callable[[DataFrame], DataFrame]


def stream_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    output_mode: str = "append",
    interval: str | None = None,
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    merge: Merge | None = None,
    merged_after: int = MERGED_AFTER,
    reused: bool = True,
) -> StreamingQuery:
    """Keep a table up to date from a stream.

    Every micro-batch overwrites its own `batch_id` folder and then commits, so a batch that is run again
    after a lost executor or driver leaves no duplicates, and one that is written by half is never
    read. With a `merge` (`latest_per_key` or `summed_per_key` with their keys) the table is an incremental
    view: after `merged_after` batches the last merged table and the batches since become the next one, and what
    only older commits name is removed. A `transform` may use its batch more than once: it is kept until it is
    written, unless it isn't `reused`. Without an `interval` the query takes what is there and stops.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        if transform is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            schema = batch.schema
        else:
            kept = batch.persist() if reused else batch
            try:
                rows = transform(kept, batch_id)
                rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
                schema = rows.schema
            finally:
                if reused:
                    kept.unpersist()
        commits, files = Commits(spark, path), Files(spark, path)
        before = commits.last(batch_id)
        mark = {"schema": schema.jsonValue(), "merged": before.get("merged"), "first": before.get("first", batch_id), "last": batch_id}
        if merge is not None and batch_id - mark["first"] + 1 >= merged_after:
            whole = merge(_committed(spark, path, mark)).withColumn("batch_id", F.lit(batch_id))
            whole.write.mode("overwrite").parquet(f"{path}/upto={batch_id}")
            mark |= {"merged": batch_id, "first": batch_id + 1}
        commits.add(batch_id, mark)
        # The commit before this one is where a repetition of this batch starts.
        oldest = before.get("first", 0)
        for name in files.names():
            kind, _, number = name.partition("=")
            if kind == "batch_id" and int(number) < oldest or kind == "upto" and int(number) not in (before.get("merged"), mark["merged"]):
                files.delete(name)

    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _committed(spark: SparkSession, path: str, mark: dict) -> DataFrame:
    schema = StructType([*StructType.fromJson(mark["schema"]).fields, StructField("batch_id", IntegerType())])
    batches = [f"{path}/batch_id={n}" for n in range(mark["first"], mark["last"] + 1)]
    whole = spark.createDataFrame([], schema)
    if batches:
        whole = spark.read.schema(schema).option("basePath", path).parquet(*batches)
    if mark["merged"] is not None:
        whole = whole.unionByName(spark.read.schema(schema).parquet(f"{path}/upto={mark['merged']}"))
    return whole


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that `stream_sink` committed, with their `batch_id`; merged rows have the one of their last
    batch. The columns are those of the commit: no file is opened to find them out."""
    mark = Commits(spark, path).last()
    if not mark:
        raise FileNotFoundError(f"no batch was committed under {path}")
    return _committed(spark, path, mark)


def latest_per_key(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows of an update-mode stream: per key the one of the last batch."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*values), F.col("batch_id")).alias("_v")
    return batches.groupBy(*keys).agg(last).select(*keys, "_v.*")


def summed_per_key(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of per-batch increments."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    return batches.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def last_batch(batches: DataFrame) -> DataFrame:
    """Rows of the last batch alone, for streams whose every batch is the whole result."""
    last = batches.agg(F.max("batch_id")).scalar()
    return batches.filter(F.col("batch_id") == last).drop("batch_id")


def run_updates(df: DataFrame, update: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now into an update of state, which must bear to be repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            update(batch, batch_id)
        finally:
            batch.unpersist()

    checkpoint = scratch_path(df.sparkSession, "stream")
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer.trigger(availableNow=True).start().awaitTermination()


def run_available(
    spark: SparkSession,
    df: DataFrame,
    output_mode: str = "append",
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    merge: Merge | None = None,
    reused: bool = True,
) -> DataFrame:
    """Run a stream over what is there now, in the shared folder, and return the written batches, merged if
    there is a `merge`. `transform` gets each micro-batch with its number; without `reused` the batch isn't kept while it is used."""
    base = scratch_path(spark, "stream")
    query = stream_sink(df, f"{base}/table", f"{base}/checkpoint", output_mode, transform=transform, merge=merge, reused=reused)
    query.awaitTermination()
    if Commits(spark, f"{base}/table").numbers():
        rows = read_batches(spark, f"{base}/table")
    else:
        # A stream without input runs no batch; an empty one gives the columns.
        none = spark.createDataFrame([], df.schema)
        rows = (none if transform is None else transform(none, 0)).limit(0).withColumn("batch_id", F.lit(0))
    return rows if merge is None else merge(rows)
