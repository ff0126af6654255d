"""Stores on disk."""

import json

from heliograph.schemas import ENTITIES, schema_of
from heliograph.sources.entities import lookup, read_entity, write_partitioned


def test_all_schemas_parse(spark):
    assert all(len(schema_of(e)) > 2 for e in ENTITIES)


def test_json_store(spark, tmp_path):
    folder = tmp_path / "leads" / "campaign_id=a"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text("\n".join([
        json.dumps({"id": "1", "name": "N", "rating": "4.5", "is_test": True, "tags": ["t"], "extra": 1}),
        "{broken", "null", "[1]", "7", json.dumps({"id": "2", "raw": {"k": [1]}}),
    ]))
    other = tmp_path / "leads" / "campaign_id=7"
    other.mkdir()
    (other / "y.json").write_text(json.dumps({"id": "3"}))
    df = read_entity(spark, str(tmp_path / "leads"), "leads", fmt="json")
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {"1", "2", "3"} and df.count() == 3
    assert rows["1"]["name"] == "N" and rows["1"]["rating"] is None and rows["1"]["tags"] == ["t"]
    assert rows["2"]["raw"] == '{"k":[1]}' and rows["3"]["campaign_id"] == "7"
    one = read_entity(spark, str(tmp_path / "leads"), "leads", partition="a", fmt="json")
    assert {r["id"] for r in one.collect()} == {"1", "2"}


def test_parquet_store_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "clicks")
    rows = [(str(i), "ab"[i % 2], "l", "e", "u", None, None, None) for i in range(10)]
    df = spark.createDataFrame(rows, schema_of("clicks"))
    write_partitioned(df, path, "campaign_id")
    write_partitioned(df.limit(1), path, "campaign_id")
    assert read_entity(spark, path, "clicks").count() == 11
    part = read_entity(spark, path, "clicks", partition="b")
    assert part.count() == 5
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(campaign_id" in plan
    assert lookup(part, "3").count() == 1


def test_missing_columns_read_as_null(spark, tmp_path):
    path = str(tmp_path / "tasks")
    spark.createDataFrame([("1", "t")], "id string, title string").write.parquet(path)
    row = read_entity(spark, path, "tasks").first()
    assert row["title"] == "t" and row["reply_id"] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_and_columns_reach_the_scan(spark, tmp_path):
    from heliograph.operators import funnel, leads, sequence

    path = str(tmp_path / "emails")
    write_partitioned(spark.createDataFrame([("1",) + ("a",) * 2 + (None,) * 18], schema_of("emails")), path, "campaign_id")
    emails = read_entity(spark, path, "emails")
    plan = plan_of(sequence.select_sendable(emails))
    assert "EqualTo(status,drafted)" in plan
    plan = plan_of(funnel.email_counters(emails))
    assert "ReadSchema: struct<status:string,click_count:bigint>" in plan
    pages = str(tmp_path / "crawl")
    spark.createDataFrame([("s", "", "c")], "site string, path string, content string").write.parquet(pages)
    plan = plan_of(leads.extract_contact_emails(spark.read.parquet(pages)))
    assert "In(path, [,/contact,/contact-us])" in plan


def test_point_read_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "tasks")
    spark.createDataFrame([("1", "t")], "id string, title string").write.parquet(path)
    assert "EqualTo(id,1)" in plan_of(lookup(read_entity(spark, path, "tasks"), "1"))


def test_a_repeated_run_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "clicks")
    rows = [(str(i), ("a", "007")[i % 2], "l", "e", "u", None, None, None) for i in range(10)]
    df = spark.createDataFrame(rows, schema_of("clicks"))
    for run, part in (("r1", df), ("r2", df.limit(3)), ("r2", df.limit(4)), ("r1", df)):
        write_partitioned(part, path, "campaign_id", run_id=run)
    stored = read_entity(spark, path, "clicks")
    assert stored.count() == 14 and stored.columns == [*stored.schema.names] and "run" not in stored.columns
    assert {r["campaign_id"] for r in stored.collect()} == {"a", "007"}
    part = read_entity(spark, path, "clicks", partition="007")
    assert {r["campaign_id"] for r in part.collect()} == {"007"}
    assert all("campaign_id=007" in f for f in part.inputFiles() if "campaign_id=" in f) or "PartitionFilters: [isnotnull(campaign_id" in plan_of(part)


def scanned(df):
    """Rows that the scans of a query gave, after whole row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.finalPhysicalPlan().collectLeaves() if "AdaptiveSparkPlan" in plan.nodeName() else plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("Scan"))


def test_clustered_store(spark, tmp_path):
    import datetime

    from heliograph.sources.entities import newest_stored, read_clustered, write_clustered

    start, path = datetime.datetime(2024, 1, 1), str(tmp_path / "log")
    ddl = "id string, at timestamp, v string"
    rows = [(f"{(i * 7919) % 60_000:06d}", start + datetime.timedelta(minutes=i // 3), "x" * (i % 50)) for i in range(60_000)] + [("none", None, "v")]
    df = spark.createDataFrame(rows, ddl)
    # The second half is written twice, by one run.
    from pyspark.sql import functions as F
    half = F.coalesce(F.col("at") < start + datetime.timedelta(days=7), F.lit(False))
    for part, run in ((half, "a"), (~half, "b"), (~half, "b")):
        write_clustered(df.filter(part), path, "at", run, group_bytes=64 << 10)
    whole = read_clustered(spark, path, df.schema)
    assert whole.count() == len(rows)
    one = whole.filter("id = '012345'")
    assert one.count() == 1 and scanned(one) < len(rows) / 10
    # An id that lies between those of the store is in no row group's Bloom filter, or nearly so.
    assert scanned(whole.filter("id = '012345x'")) < len(rows) / 20
    assert lookup(whole, "012345").first()["id"] == "012345" and lookup(whole, "none").count() == 1
    newest = newest_stored(spark, path, df.schema, "at", 500)
    want = sorted((r for r in rows if r[1]), key=lambda r: (-r[1].timestamp(), r[0]))[:500]
    assert [tuple(r) for r in newest.collect()] == want
    folders = {f.split("day=")[1].split("/")[0] for f in newest.inputFiles()}
    assert folders == {"2024-01-14"}
    assert newest_stored(spark, path, df.schema, "at", 10**6).count() == len(rows)
    assert newest_stored(spark, path, df.schema, "at", 10**6).collect()[-1]["id"] == "none"
