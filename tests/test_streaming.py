"""Streams over several micro-batches against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import lifecycle
from heliograph.sources.entities import stream_entity, write_partitioned
from heliograph.sources.ingest import parse_webhook_events
from heliograph.operators.correlation import dedupe_deliveries
from heliograph.streaming import jobs, sinks

DDL = "email_id string, campaign_id string, at timestamp, event_id string, status string, kind string"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """Four files in order of arrival; one e-mail has a third of the events."""
    rng = random.Random(3)
    kinds = [("sent", "ack"), ("sent", "provider"), ("delivered", "provider"), ("bounced", "provider"), ("clicked", "click"), ("replied", "reply")]
    folder = tmp_path_factory.mktemp("events")
    n = 0
    for part in range(4):
        rows = []
        for _ in range(150):
            key = "hot" if rng.random() < 0.33 else str(rng.randrange(20))
            status, kind = rng.choice(kinds)
            rows.append((key, "c" + key[-1], START + datetime.timedelta(minutes=n), f"{n:05d}", status, kind))
            n += 1
        rng.shuffle(rows)
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/f{part}")
    return str(folder)


def stream(spark, folder):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_status_over_batches(spark, event_files):
    out = sinks.run_available(spark, jobs.stream_email_status(stream(spark, event_files)), "update")
    assert out.select("batch_id").distinct().count() == 4
    batch = lifecycle.fold_email_status(spark.read.parquet(f"{event_files}/*"))
    assert rows(sinks.latest_per_key(out, ["email_id"])) == rows(batch)


def test_marked_events_over_batches(spark, event_files, tmp_path):
    marker = jobs.arrival_order_marker(spark, str(tmp_path))
    out = sinks.run_available(spark, stream(spark, event_files), transform=marker).drop("batch_id")
    batch = lifecycle.mark_applied(spark.read.parquet(f"{event_files}/*"))
    assert rows(out) == rows(batch.select(out.columns))


def test_campaign_counters_over_batches(spark, event_files, tmp_path):
    increments = jobs.marked_increments(spark, str(tmp_path))
    out = sinks.run_available(spark, stream(spark, event_files), transform=increments)
    batch = lifecycle.event_counters(lifecycle.mark_applied(spark.read.parquet(f"{event_files}/*")))
    assert rows(sinks.summed_per_key(out, ["campaign_id"])) == rows(batch)


def test_a_batch_run_again_leaves_no_duplicates(spark, event_files, tmp_path):
    def start():
        marker = jobs.arrival_order_marker(spark, f"{tmp_path}/ranks")
        return sinks.stream_sink(stream(spark, event_files), f"{tmp_path}/table", f"{tmp_path}/checkpoint", transform=marker)

    start().awaitTermination()
    first = rows(sinks.read_batches(spark, f"{tmp_path}/table"))
    # Forget that the last batch was committed, as if the driver had died right before.
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "checkpoint" / "commits").glob(f"*{last}*"):
        p.unlink()
    start().awaitTermination()
    assert rows(sinks.read_batches(spark, f"{tmp_path}/table")) == first


def test_redeliveries_across_batches(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame(
            [("a", "w", None, '{"event_id":"x"}', START), (f"b{i}", "w", None, "no json", START)],
            "id string, webhook_id string, headers map<string,string>, raw_body string, received_at timestamp",
        ).coalesce(1).write.parquet(f"{tmp_path}/f{i}")
    raw = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/f0").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    events = parse_webhook_events(raw).withColumn("event_id", F.col("event.event_id")).select("id", "event_id", "received_at")
    out = sinks.run_available(spark, dedupe_deliveries(events))
    assert sorted(r["id"] for r in out.collect()) == ["a", "b0", "b1"]


def test_a_late_call_is_not_a_redelivery(spark, tmp_path):
    hours = lambda n: START - datetime.timedelta(hours=n)
    for i, row in enumerate([("x", hours(0)), ("y", hours(0)), ("z", hours(5))]):
        spark.createDataFrame([(row[0], row[0], row[1])], "id string, event_id string, received_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/f{i}")
    schema = "id string, event_id string, received_at timestamp"
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    out = sinks.run_available(spark, dedupe_deliveries(calls))
    assert sorted(r["id"] for r in out.collect()) == ["x", "y", "z"]


def test_probe_window(spark):
    second = datetime.timedelta(seconds=1)
    events = spark.createDataFrame(
        [("w", START - second), ("w", START), ("w", START + 14.9 * second), ("w", START + 15 * second), ("v", START + second)],
        "webhook_id string, received_at timestamp",
    )
    probes = spark.createDataFrame([("p", "w", START), ("q", "w", START + 16 * second), ("r", "v", START - 13 * second)], "probe_id string, webhook_id string, since timestamp")
    got = {r["probe_id"]: (r["new_events"], r["ok"]) for r in jobs.webhook_health(probes, jobs.probe_arrivals(events, probes)).collect()}
    assert got == {"p": (2, True), "q": (0, False), "r": (1, True)}


def test_store_as_stream(spark, tmp_path):
    from heliograph.schemas import schema_of

    path = str(tmp_path / "clicks")
    df = spark.createDataFrame([(str(i), "a", "l", "e", "u", None, None, START) for i in range(3)], schema_of("clicks"))
    write_partitioned(df, path, "campaign_id", fmt="parquet")
    out = sinks.run_available(spark, stream_entity(spark, path, "clicks", max_files=1))
    assert out.count() == 3 and {r["campaign_id"] for r in out.collect()} == {"a"}


def test_running_query_and_empty_stream(spark, event_files, tmp_path):
    query = sinks.stream_sink(
        jobs.stream_email_status(stream(spark, event_files)), f"{tmp_path}/t", f"{tmp_path}/c", "update", interval="1 second"
    )
    query.processAllAvailable()
    query.stop()
    batch = lifecycle.fold_email_status(spark.read.parquet(f"{event_files}/*"))
    assert rows(sinks.latest_per_key(sinks.read_batches(spark, f"{tmp_path}/t"), ["email_id"])) == rows(batch)
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(DDL).parquet(f"{tmp_path}/none")
    assert sinks.run_available(spark, jobs.stream_email_status(empty), "update").count() == 0


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from heliograph import session

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster())
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_clicks_without_state(spark, tmp_path):
    """Clicks of several batches are counted per batch and merged; no state of e-mails is kept by the stream."""
    from heliograph.functions.tokens import encode_click_token

    token = encode_click_token(F.lit("c"), F.lit("l"), F.col("email"), F.lit("https://shop.test/"))
    rows = [("a", "2024-01-03"), ("b", "2024-01-01"), ("a", "2024-01-02"), (None, "2024-01-01")]
    for k, (email, day) in enumerate(rows):
        row = spark.createDataFrame([(email, day)], "email string, day string")
        row.select(token.alias("token"), F.col("day").cast("timestamp").alias("clicked_at")).coalesce(1).write.parquet(str(tmp_path / f"part={k}"))
    source = spark.readStream.schema("token string, clicked_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part=*")
    clicks = jobs.stream_clicks(source)
    assert "Aggregate" not in clicks._jdf.queryExecution().analyzed().toString()
    merged = sinks.run_available(spark, clicks, transform=jobs.click_increments, merge=jobs.merge_click_stats, reused=False)
    found = {(r.email_id, r.click_count, str(r.last_clicked_at)[:10]) for r in merged.collect()}
    assert found == {("a", 2, "2024-01-03"), ("b", 1, "2024-01-01")}
