"""Entity tables on disk: JSON documents or parquet, partitioned by the leading key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from heliograph.functions.json import is_json
from heliograph.functions.text import js_trim_start
from heliograph.operators.ordering import newest_first
from heliograph.schemas import PARTITION_KEYS, schema_of
from heliograph.sources.files import Files


def _stored_schema(entity: str, schema: StructType | None) -> tuple[StructType, StructField | None]:
    """The schema inside the files and the field that comes from the folder names."""
    full = schema or schema_of(entity)
    key = PARTITION_KEYS.get(entity)
    inside = StructType([f for f in full if f.name != key])
    return inside, (full[key] if key in full.fieldNames() else None)


def _line_schema(key: StructField | None) -> StructType:
    """A line of text and the key of its folder, whose type must not be guessed: `007` is no number."""
    line = StructType().add("value", "string")
    return line if key is None else line.add(key)


def _parse_documents(lines: DataFrame, inside: StructType, key: StructField | None) -> DataFrame:
    """One JSON document per line; lines that are not JSON objects are skipped.

    The check looks at the syntax alone: a document with one odd field keeps its other fields.
    """
    value = F.col("value")
    rows = lines.filter(js_trim_start(value).startswith("{") & is_json(value)).withColumn("doc", F.from_json("value", inside))
    columns = [F.col(f"doc.`{f.name}`").alias(f.name) for f in inside]
    if key is not None:
        columns.append(F.col(key.name).cast(key.dataType).alias(key.name))
    return rows.select(*columns)


def read_entity(
    spark: SparkSession,
    path: str,
    entity: str,
    partition: str | None = None,
    fmt: str = "parquet",
    schema: StructType | None = None,
) -> DataFrame:
    """Scan one store, or only the part under one key prefix, which prunes the other folders."""
    inside, key = _stored_schema(entity, schema)
    if fmt == "json":
        df = _parse_documents(spark.read.schema(_line_schema(key)).text(path), inside, key)
    else:
        whole = StructType([*inside.fields, *([key] if key is not None else [])])
        # Folders of runs above those of the key add a column.
        df = spark.read.schema(whole).parquet(path).select(*whole.names)
    return df if partition is None else df.filter(F.col(key.name) == partition)


def stream_entity(
    spark: SparkSession,
    path: str,
    entity: str,
    fmt: str = "parquet",
    max_files: int | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """The same store as a stream of newly added files."""
    inside, key = _stored_schema(entity, schema)
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        lines = reader.schema(_line_schema(key)).text(path)
        return _parse_documents(lines, inside, key)
    whole = StructType([*inside.fields, *([key] if key is not None else [])])
    return reader.schema(whole).parquet(path).select(*whole.names)


def write_partitioned(df: DataFrame, path: str, key: str, fmt: str = "parquet", run_id: str | None = None) -> None:
    """Append rows under their leading key.

    The rebalance gathers small keys, so that folders do not fill up with one file per task, and
    splits a key that holds most of the rows into writes of ordinary size. With a `run_id` the rows go
    under a folder of that run, and the run written again replaces itself: a job that is repeated after a failure
    leaves one copy. A store is written with run ids throughout, or without.
    """
    writer = df.hint("rebalance", key).write.partitionBy(key).format(fmt)
    if run_id is None:
        writer.mode("append").save(path)
    else:
        writer.mode("overwrite").save(f"{path}/run={run_id}")


def lookup(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Point read by id; the predicate reaches the scan."""
    return df.filter(F.col(column) == value).limit(1)


#: Rows of a row group of a clustered store, about: what a point read decodes.
GROUP_BYTES = 16 << 20


def write_clustered(df: DataFrame, path: str, at: str, run_id: str, key: str = "id", group_bytes: int = GROUP_BYTES) -> None:
    """Append rows to a store laid out for the newest rows and for single ids: a folder per day of `at`, in
    it files of consecutive keys, sorted, with the least and greatest key and a Bloom filter of the keys in
    every row group. A run written again replaces what it wrote.
    """
    day = F.to_date(F.col(at))
    placed = df.withColumn("day", day).withColumn("run", F.lit(run_id))
    # Ranges of (day, key): a busy day is split over tasks, a quiet one is one file.
    ranged = placed.repartitionByRange("day", key).sortWithinPartitions("day", key)
    writer = ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run")
    writer = writer.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def read_clustered(spark: SparkSession, path: str, schema: StructType, days: list[str] | None = None) -> DataFrame:
    """A clustered store, or some of its days alone. A `lookup` on it skips the row groups without the id."""
    whole = StructType([*schema.fields, StructField("day", DateType()), StructField("run", StringType())])
    folders = [path] if days is None else [f"{path}/{d}" for d in days]
    return spark.read.schema(whole).option("basePath", path).parquet(*folders).select(*schema.names)


def newest_stored(spark: SparkSession, path: str, schema: StructType, at: str, limit: int, tie: str = "id") -> DataFrame:
    """The newest rows of a clustered store. Days are opened from the newest on, twice as many at a time, until
    they hold enough rows; their numbers of rows come from the files' footers. Rows without a time come last."""
    names = [n for n in Files(spark, path).names() if n.startswith("day=")]
    names.sort(key=lambda n: "" if "HIVE_DEFAULT" in n else n, reverse=True)
    count = 1
    while count < len(names) and read_clustered(spark, path, schema, names[:count]).count() < limit:
        count *= 2
    return newest_first(read_clustered(spark, path, schema, names[:count]), at, limit, tie)
