"""Plans when one key holds a third of the rows: splits happen, and nothing is lost by them."""

import contextlib

import pytest
from pyspark.sql import functions as F

from heliograph.operators import correlation, feed, lifecycle, sequence, sessions

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, df):
    """Rows and the plan after run-time changes."""
    with settings(spark, SMALL):
        rows = df.collect()
        return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def emails(spark):
    """Thread t0 and lead l0 have half of the e-mails."""
    n = F.col("id")
    thread = F.when(n % 2 == 0, 0).otherwise(n)
    return spark.range(0, 4000, 1, 8).select(
        n.cast("string").alias("id"), F.lit("c").alias("campaign_id"), F.concat(F.lit("l"), thread.cast("string")).alias("lead_id"),
        F.when(n % 3 == 0, "replied").otherwise("drafted").alias("status"), F.lit(2).alias("sequence_position"),
        F.concat(F.lit("m"), n.cast("string")).alias("agentmail_message_id"),
        F.concat(F.lit("t"), thread.cast("string")).alias("agentmail_thread_id"),
        F.timestamp_seconds(n).alias("created_at"),
    )


def test_busy_thread(spark, emails):
    n = F.col("id")
    events = spark.range(0, 6000, 1, 8).select(
        n.cast("string").alias("id"), F.lit(None).cast("string").alias("message_id"),
        F.when(n % 3 != 0, F.lit("t0")).otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("thread_id"),
    )
    with settings(spark, SMALL):
        rows, plan = run(spark, correlation.correlate_events(events, emails))
    assert "skew=true" in plan and "NestedLoop" not in plan
    assert len(rows) == 4000 + sum(1 for i in range(0, 4000, 3) if i == 0 or i % 2)
    assert {r["email_id"] for r in rows if r["thread_id"] == "t0"} == {"0"}


def test_missing_keys_do_not_meet(spark):
    n = F.col("id")
    rows = spark.range(0, 6000, 1, 8).select(
        n.cast("string").alias("id"), F.when(n % 10 == 0, F.lit("g")).alias("agent_id"), F.lit("task").alias("category"),
        F.lit("s").alias("summary"), F.lit(None).cast("string").alias("details"), F.timestamp_seconds(n).alias("created_at"),
    )
    agents = spark.createDataFrame([("g", "x")], "id string, emoji string")
    with settings(spark, {**SMALL, "spark.sql.adaptive.enabled": "false"}):
        out = feed.activity_with_agent(rows, agents)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2500


def test_busy_lead(spark, emails):
    with settings(spark, SMALL):
        rows, plan = run(spark, sequence.select_sendable(emails, step=2))
    expected = [i for i in range(4000) if i % 3 and i % 2]
    assert sorted(int(r["id"]) for r in rows) == expected
    assert "skew=true" in plan


def test_busy_pair_of_new_drafts(spark, emails):
    with settings(spark, SMALL):
        rows, plan = run(spark, sequence.dedupe_new_drafts(emails, emails.limit(0)))
    kept = {int(r["id"]) for r in rows if not r["skipped"]}
    assert len(rows) == 4000 and kept == {0} | {i for i in range(4000) if i % 2}
    assert "skew=true" in plan


def even(spark, df, column):
    """Rows per partition of the last shuffle."""
    with settings(spark, {**SMALL, "spark.sql.shuffle.partitions": "16"}):
        rows = df().select(F.spark_partition_id().alias("p"), column).groupBy("p").agg(F.count(column)).collect()
    return [r[1] for r in rows]


def test_busy_email_is_ranked_in_many_tasks(spark):
    n = F.col("id")
    events = spark.range(0, 30000, 1, 8).select(
        F.when(n % 3 == 0, F.lit("hot")).otherwise((n % 5000).cast("string")).alias("email_id"),
        F.timestamp_seconds(n * 60).alias("at"), n.cast("string").alias("event_id"),
        F.when(n % 2 == 0, "sent").otherwise("bounced").alias("status"), F.lit("provider").alias("kind"),
    )
    sizes = even(spark, lambda: lifecycle.mark_applied(events), "applied")
    assert sum(sizes) == 30000 and max(sizes) < 4000


def test_busy_ten_minutes_are_ranked_in_many_tasks(spark):
    hot = F.col("id") % 3 == 0
    at = F.when(hot, F.col("id") % 600).otherwise(F.col("id") * 997 % 2_000_000)
    events = spark.range(0, 20_000, 1, 8).select(
        F.when(hot, "hot").otherwise((F.col("id") % 4000).cast("string")).alias("email_id"),
        F.timestamp_seconds(at + 1_700_000_000).alias("at"), F.col("id").cast("string").alias("event_id"),
        F.element_at(F.array(*map(F.lit, ("sent", "delivered", "bounced", "clicked"))), (F.col("id") % 4 + 1).cast("int")).alias("status"),
        F.lit("provider").alias("kind"),
    )
    sizes = even(spark, lambda: lifecycle.mark_applied(events, block_rows=60), "applied")
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    whole, cut = (lifecycle.mark_applied(events, block_rows=n) for n in (10**9, 60))
    assert whole.exceptAll(cut).count() == 0 == cut.exceptAll(whole).count()


def test_long_session_is_folded_in_many_tasks(spark):
    n = F.col("id")
    chunks = spark.range(0, 20000, 1, 8).select(
        F.when(n % 3 != 0, F.lit("long")).otherwise((n % 999).cast("string")).alias("session_id"), n.alias("seq"),
        F.lit("user").alias("role"), n.cast("string").alias("text"), F.lit(True).alias("final"),
    )
    sizes = even(spark, lambda: sessions.fold_transcript(chunks, block=200), "text")
    assert sum(sizes) == 20000 and max(sizes) < 3500


def test_busy_key_is_written_in_pieces(spark, tmp_path):
    from heliograph.sources.entities import write_partitioned

    n = F.col("id")
    rows = spark.range(0, 40000, 1, 8).select(
        n.cast("string").alias("id"), F.sha2(n.cast("string"), 256).alias("text"),
        F.when(n % 3 != 0, F.lit("hot")).otherwise((n % 5).cast("string")).alias("campaign_id"),
    )
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB"}):
        write_partitioned(rows, str(tmp_path / "t"), "campaign_id")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").iterdir() if d.is_dir()}
    assert files["campaign_id=hot"] > 3 and max(c for k, c in files.items() if "hot" not in k) <= 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40000


def test_newest_rows_of_a_busy_group(spark):
    from heliograph.operators.ordering import newest_per_group

    n = F.col("id")
    rows = spark.range(0, 20000, 1, 16).select(
        n.cast("string").alias("id"), F.when(n % 3 != 0, F.lit("hot")).otherwise((n % 9).cast("string")).alias("campaign_id"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("created_at"),
    )
    got = newest_per_group(rows, "campaign_id", 7, "created_at")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["campaign_id"], []).append((-r["created_at"].timestamp(), r["id"]))
    expected = {(k, i) for k, members in by_group.items() for _, i in sorted(members)[:7]}
    assert {(r["campaign_id"], r["id"]) for r in got.collect()} == expected
