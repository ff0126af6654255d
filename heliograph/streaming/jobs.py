"""Streaming forms of the e-mail status, campaign counters, feed, clicks and webhook health."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, StructField, StructType

from heliograph.operators.blocks import MOST_ROWS, time_blocks
from heliograph.operators.correlation import (
    FOUND, classify_event, click_stats, dedupe_deliveries, delivery_key, extract_message_ids, extract_replies, first_emails, match_events,
    match_replies, merge_first_emails, route_events,
)
from heliograph.operators.feed import FEED_COLUMNS, LIVE_ROWS, REMEMBERED_ROWS, activity_feed, dedupe_feed
from heliograph.operators.lifecycle import (
    STATUS_STATE, event_counters, fold_email_status, lifecycle_events, mark_applied, merge_status_states,
    ranks_after, status_state,
)
from heliograph.operators.snapshots import merge_snapshot_states, snapshot_state
from heliograph.sources.files import Files
from heliograph.sources.ingest import decode_click_tokens
from heliograph.streaming.state import KeyedState, SeenIds, TimedState

PROBE_SECONDS = 15


def stream_email_status(events: DataFrame) -> DataFrame:
    """Status per e-mail, in update mode: the batch fold as it is.

    Its state is one position per status, so it needs no Python and no sorting, and events that
    arrive late are put where they belong. Rows of one e-mail combine before they reach its state.
    """
    return fold_email_status(events)


def arrival_order_marker(spark: SparkSession, state: str, buckets: int | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """What makes micro-batches of events into events with `applied`, judged in order of arrival.

    The ranks that e-mails have reached are kept by hash bucket under `state`. A batch enters with the ranks of
    its own buckets and is judged by the batch operator; other buckets are neither read nor written. A batch
    that is run again finds the ranks of the batch before it and overwrites its own.
    """
    ranks = KeyedState(spark, state, "email_id STRING, rank INT", "email_id", buckets)

    def mark(batch: DataFrame, batch_id: int) -> DataFrame:
        merge = lambda before, events: ranks_after(events, before)
        entered = ranks.update(batch, [batch.select("email_id")], batch_id, merge)
        return mark_applied(batch, entered=entered)

    return mark


class EmailIndex:
    """The first e-mail under each message and thread id, kept by the stream of e-mails by hash bucket. Calls
    look up the buckets of their own ids; no batch scans the e-mails."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        schema = f"provider_id STRING, hit {FOUND}"
        self.by_message = KeyedState(spark, f"{path}/message", schema, "provider_id", buckets)
        self.by_thread = KeyedState(spark, f"{path}/thread", schema, "provider_id", buckets)

    def add(self, emails: DataFrame, batch_id: int) -> None:
        """E-mails of one micro-batch; a repetition changes nothing."""
        for table, column in ((self.by_message, "agentmail_message_id"), (self.by_thread, "agentmail_thread_id")):
            first = first_emails(emails, column)
            table.update(first, [first.select("provider_id")], batch_id, merge_first_emails)

    @staticmethod
    def _held(table: KeyedState, ids: DataFrame) -> DataFrame:
        """What a table knows of some ids, from their buckets."""
        return table.read(table.touched(ids.filter(F.col(ids.columns[0]).isNotNull())))

    def match_events(self, events: DataFrame) -> DataFrame:
        """As `correlate_events`, against all e-mails added so far."""
        messages, threads = events.select("message_id"), events.select("thread_id")
        return match_events(events, self._held(self.by_message, messages), self._held(self.by_thread, threads))

    def match_replies(self, replies: DataFrame) -> DataFrame:
        """As `correlate_replies`, against all e-mails added so far."""
        return match_replies(replies, self._held(self.by_thread, replies.select("agentmail_thread_id")))


def status_of_calls(calls: DataFrame, webhooks: DataFrame, index: EmailIndex) -> DataFrame:
    """The lifecycle events in one micro-batch of webhook calls; clicks don't come as calls and aren't in it."""
    routed = route_events(calls, webhooks)
    provider = classify_event(extract_message_ids(routed)).select("id", "message_id", "thread_id", "status", "received_at")
    return lifecycle_events(index.match_events(provider), index.match_replies(extract_replies(routed)))


def status_keeper(spark: SparkSession, state: str, events_of: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> tuple[KeyedState, Callable[[DataFrame, int], None]]:
    """A table of e-mail states by hash bucket, and what merges the events of a micro-batch into it."""
    states = KeyedState(spark, state, STATUS_STATE, "email_id", buckets)

    def update(batch: DataFrame, batch_id: int) -> None:
        new = status_state(events_of(batch)).persist()
        try:
            states.update(new, [new.select("email_id")], batch_id, merge_status_states)
        finally:
            new.unpersist()

    return states, update


def marked_increments(spark: SparkSession, state: str) -> Callable[[DataFrame, int], DataFrame]:
    """The same, reduced to the increments of the campaign counters."""
    mark = arrival_order_marker(spark, state)
    return lambda batch, batch_id: campaign_increments(mark(batch, batch_id))


def campaign_increments(marked_batch: DataFrame) -> DataFrame:
    """Increments of the campaign counters from one micro-batch of marked events. Written per batch
    and summed on reading, so there is no counter to lose updates on."""
    return event_counters(marked_batch)


def stream_activity_feed(*sources: DataFrame) -> DataFrame:
    """The feed over streams, in append mode."""
    return activity_feed(*sources)


def stream_clicks(tokens: DataFrame) -> DataFrame:
    """E-mail and time of each click from raw tokens, in append mode: what `click_increments` counts."""
    return decode_click_tokens(tokens).filter("logged").select("email_id", "clicked_at")


def click_increments(clicks: DataFrame, batch_id: int) -> DataFrame:
    """Click counters per e-mail from one micro-batch. Written per batch and merged on reading, so that no state of
    all e-mails is opened and committed with every batch."""
    return click_stats(clicks)


def merge_click_stats(rows: DataFrame) -> DataFrame:
    """Counters per e-mail from those of several batches."""
    return rows.groupBy("email_id").agg(F.sum("click_count").alias("click_count"), F.max("last_clicked_at").alias("last_clicked_at"))


def probe_arrivals(
    events: DataFrame, probes: DataFrame, seconds: int = PROBE_SECONDS, block_seconds: int = 3600,
    block_rows: int = MOST_ROWS,
) -> DataFrame:
    """Events that arrived within the window after each probe `(probe_id, webhook_id, since)`.

    No event is paired with a probe. Events and the two ends of every window are put in order, and
    the events before either end are counted by a running sum, whose difference is the answer. The
    sum runs in time blocks of one webhook, cut further where they are busy, and starts from the total of
    the blocks before, so a busy webhook is split over tasks. Probes without arrivals are left out.
    """
    def end(offset: int, sign: int) -> DataFrame:
        at = F.timestamp_micros(F.unix_micros("since") + offset * 1_000_000)
        return probes.select("webhook_id", at.alias("at"), F.lit(0).alias("n"), "probe_id", F.lit(sign).alias("sign"))

    # Calls of one moment are one row.
    counted = events.groupBy("webhook_id", F.col("received_at").alias("at")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = counted.unionByName(end(0, -1).unionByName(end(seconds, 1)), allowMissingColumns=True)
    rows = time_blocks(rows, "webhook_id", "at", block_seconds, block_rows, "block")
    by_block = W.partitionBy("webhook_id").orderBy("block")
    entries = (
        rows.groupBy("webhook_id", "block").agg(F.sum("n").alias("n"))
        .withColumn("n", F.sum("n").over(by_block.rowsBetween(W.unboundedPreceding, -1)))
        .filter("n IS NOT NULL")
    )
    # The block's entry comes first, and the end of a window before an event of the same moment.
    order = W.partitionBy("webhook_id", "block").orderBy("at", "n").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.unionByName(entries, allowMissingColumns=True)
        .withColumn("before", F.sum("n").over(order))
        .filter("probe_id IS NOT NULL")
        .groupBy("probe_id")
        .agg(F.sum(F.col("sign") * F.col("before")).alias("new_events"))
        .filter("new_events > 0")
    )


def redelivery_filter(spark: SparkSession, state: str, fanout: int = 8) -> Callable[[DataFrame, int], DataFrame]:
    """What drops redelivered provider events from micro-batches, as `dedupe_deliveries` does on a table: of
    each batch the first delivery of events that no batch before had. Ids are kept in tables, never dropped for
    their age, and only compared exactly where Bloom bits say that they may have come before."""
    ids = SeenIds(spark, state, fanout)

    def first(batch: DataFrame, batch_id: int) -> DataFrame:
        once = dedupe_deliveries(batch)
        keyed = once.withColumn("_key", delivery_key())
        new = ids.admit(keyed.select(F.col("_key").alias("key")), batch_id)
        return keyed.join(new, keyed["_key"] == new["key"], "left_semi").drop("_key")

    return first


class ArrivalCounter:
    """Calls and probes as one stream of rows (`kind` call or probe, `webhook_id`, `at`, `probe_id`) to the
    number of calls within each probe's window.

    Either may come first: a micro-batch counts its calls in the windows of the probes up to then, and the
    earlier calls in the windows of its own probes. Both are kept by spans of time, and a batch opens the
    spans that its own windows reach into, no others. Its counts are increments, to be summed.
    """

    def __init__(self, spark: SparkSession, state: str, seconds: int = PROBE_SECONDS, span_seconds: int = 3600) -> None:
        self.seconds = seconds
        self.calls = TimedState(spark, f"{state}/calls", "webhook_id STRING, received_at TIMESTAMP", "received_at", span_seconds)
        self.probes = TimedState(spark, f"{state}/probes", "probe_id STRING, webhook_id STRING, since TIMESTAMP", "since", span_seconds)

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        calls = batch.filter("kind = 'call'").select("webhook_id", F.col("at").alias("received_at"))
        probes = batch.filter("kind = 'probe'").select("probe_id", "webhook_id", F.col("at").alias("since"))
        earlier = probe_arrivals(calls, self._near(self.probes, batch, "call", -self.seconds, batch_id).unionByName(probes), self.seconds)
        later = probe_arrivals(self._near(self.calls, batch, "probe", self.seconds, batch_id), probes, self.seconds)
        self.calls.add(calls, batch_id)
        self.probes.add(probes, batch_id)
        return earlier.unionByName(later).groupBy("probe_id").agg(F.sum("new_events").alias("new_events"))

    def _near(self, state: TimedState, batch: DataFrame, kind: str, offset: int, batch_id: int) -> DataFrame:
        """What earlier batches left in the spans of a batch's rows and of the other end of their windows."""
        other = F.timestamp_micros(F.unix_micros("at") + offset * 1_000_000)
        spans = batch.filter(F.col("kind") == kind).select(F.explode(F.array(state.span(F.col("at")), state.span(other))).alias("s"))
        # One number per span of the batch.
        return state.read([r.s for r in spans.distinct().collect()], batch_id)


class LiveFeed:
    """The live list over micro-batches of feed rows: the newest rows so far, with what was flashed.

    The list is all that is remembered: LIVE_ROWS rows, written anew for each batch. As in `flag_new_entries`
    the newest row flashes unless it was remembered before, and the top rows are remembered with a flash; ids that
    have left the list are forgotten, for nothing that is older than the list comes back to its top. An entry's
    time is taken not to change: an older row of an id whose newer one is in the list replaces it, one that
    comes after that has left doesn't count.
    """

    def __init__(self, spark: SparkSession, state: str, n: int = LIVE_ROWS) -> None:
        self.spark, self.state, self.n = spark, state, n

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        schema = [*batch.select(*FEED_COLUMNS).schema.fields, StructField("flashed", BooleanType()), StructField("remembered", BooleanType())]
        before = self.spark.createDataFrame([], StructType(schema))
        if batch_id:
            before = self.spark.read.schema(before.schema).parquet(f"{self.state}/before={batch_id}")
        rows = dedupe_feed(before.select(*FEED_COLUMNS).unionByName(batch.select(*FEED_COLUMNS)), self.n)
        # A list of at most n rows: one task is right for it.
        whole = W.orderBy(F.col("created_at").desc_nulls_last(), "id")
        known = before.select("id", "flashed", "remembered").dropDuplicates(["id"])
        old = F.coalesce("remembered", F.lit(False))
        placed = rows.join(known, "id", "left").withColumn("position", F.row_number().over(whole)).withColumn("_flash", (F.col("position") == 1) & ~old)
        flash = F.max("_flash").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        now = placed.select(
            *FEED_COLUMNS, (F.coalesce("flashed", F.lit(False)) | F.col("_flash")).alias("flashed"),
            (old | (flash & (F.col("position") <= REMEMBERED_ROWS))).alias("remembered"), "position",
        )
        now.drop("position").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/before={batch_id + 1}")
        Files(self.spark, self.state).delete(f"before={batch_id - 1}")
        return self.spark.read.schema(before.schema).parquet(f"{self.state}/before={batch_id + 1}").withColumn("position", F.row_number().over(whole))


def snapshot_keeper(
    spark: SparkSession, state: str, changes: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], buckets: int | None = None,
) -> tuple[KeyedState, Callable[[DataFrame, int], None]]:
    """A snapshot's state by hash bucket, and what merges more changes into it. `changes` gives the columns."""
    empty = snapshot_state(changes.limit(0), [key], fields, order)
    states = KeyedState(spark, state, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema), key, buckets)

    def update(batch: DataFrame, batch_id: int) -> None:
        new = snapshot_state(batch, [key], fields, order).persist()
        try:
            states.update(new, [new.select(key)], batch_id, lambda one, other: merge_snapshot_states(one, other, [key]))
        finally:
            new.unpersist()

    return states, update


def webhook_health(probes: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Probes with their verdict; those without any arrival fail."""
    n = F.coalesce("new_events", F.lit(0))
    return probes.join(arrivals, "probe_id", "left").select(
        "probe_id", "webhook_id", n.alias("new_events"), (n > 0).alias("ok")
    )
