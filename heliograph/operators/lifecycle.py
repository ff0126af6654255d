"""E-mail status from ordered lifecycle events.

An event has `email_id`, its time `at`, an `event_id`, a `status` and a `kind`:

* `ack`       the send call succeeded; always sets `sent`
* `provider`  a lifecycle call from the mail provider; guarded by rank, see below
* `click`     a tracked click; `replied` stays, anything else becomes `clicked`
* `reply`     an inbound reply; always sets `replied`

A provider status applies when it is negative or when its rank is at least that of the current one.
Negative statuses rank zero, so they always apply and the next status replaces them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from heliograph.operators.blocks import MOST_ROWS, time_blocks

# How far an e-mail has come, and the statuses that end it.
STATUS_RANK = {"drafted": 0, "sent": 1, "delivered": 2, "clicked": 3, "replied": 4}
NEGATIVE = ("bounced", "complained", "failed")

_FORWARD = ("sent", "delivered", "clicked", "replied")
_STAMPED = ("sent", "delivered", "bounced", "complained", "failed")


def is_reset() -> Column:
    """Events that set the status whatever it was before."""
    return F.coalesce((F.col("kind") == "ack") | F.col("status").isin(*NEGATIVE), F.lit(False))


def status_rank(c: Column) -> Column:
    rank = F.lit(0)
    for status in _FORWARD:
        rank = F.when(c == status, STATUS_RANK[status]).otherwise(rank)
    return rank


def lifecycle_events(
    provider: DataFrame | None = None,
    replies: DataFrame | None = None,
    clicks: DataFrame | None = None,
    sends: DataFrame | None = None,
) -> DataFrame:
    """The event log of the e-mails from what was matched to them; tables or streams.

    `provider` events carry a `status`, `clicks` a `matched` flag, `replies` an `original_email_id`,
    and `sends` are `(id, email_id, campaign_id, sent_at)` of accepted send calls. Events are in order of
    arrival; `stamp` is the time that a reply states itself, where it has one.
    """
    def part(df: DataFrame, email: str, at: str, status: Column, kind: str, stamp: str | None = None) -> DataFrame:
        return df.filter(F.col(email).isNotNull()).select(
            F.col(email).alias("email_id"), "campaign_id", F.col(at).alias("at"), F.col("id").alias("event_id"),
            status.alias("status"), F.lit(kind).alias("kind"), F.col(stamp or at).alias("stamp"),
        )

    parts = []
    if provider is not None:
        parts.append(part(provider, "email_id", "received_at", F.col("status"), "provider"))
    if replies is not None:
        arrived = "arrived_at" if "arrived_at" in replies.columns else "received_at"
        parts.append(part(replies, "original_email_id", arrived, F.lit("replied"), "reply", "received_at"))
    if clicks is not None:
        parts.append(part(clicks.filter("matched"), "email_id", "clicked_at", F.lit("clicked"), "click"))
    if sends is not None:
        parts.append(part(sends, "email_id", "sent_at", F.lit("sent"), "ack"))
    return reduce(DataFrame.unionByName, parts)


def with_status(emails: DataFrame, events: DataFrame) -> DataFrame:
    """E-mails after the events of their log, judged on top of what is stored.

    A provider status that doesn't reach the stored one changes nothing; clicks add to the stored number;
    each status that took effect leaves its last time in `<status>_at`, a reply the time that it states.
    E-mails without events stay as they are.
    """
    stored = emails.select(F.col("id").alias("email_id"), status_rank(F.col("status")).alias("rank"))
    marked = mark_applied(events, entered=stored)
    here = F.struct("at", "event_id")
    took = F.when(F.col("applied"), here)
    log = marked.groupBy("email_id").agg(
        F.max(F.when(F.col("applied"), F.struct("at", "event_id", "status")))["status"].alias("_status"),
        F.nullif(F.count_if(F.col("kind") == "click"), F.lit(0)).alias("_clicks"),
        F.max(F.when(F.col("kind") == "click", F.col("at"))).alias("_last_clicked_at"),
        *[F.max(F.when(F.col("status") == s, took))["at"].alias(f"_{s}_at") for s in _STAMPED],
        F.max(F.when(F.col("status") == "replied", F.struct("at", "event_id", "stamp")))["stamp"].alias("_replied_at"),
    )
    known = set(emails.columns)
    times = ["last_clicked_at", *(f"{s}_at" for s in _STAMPED), "replied_at"]

    def latest(c: str) -> Column:
        found = F.col(f"_{c}")
        if c not in known:
            return found
        return F.greatest(found, c) if c == "last_clicked_at" else F.coalesce(found, c)

    clicks = F.when(F.col("_clicks").isNull(), F.col("click_count")).otherwise(F.coalesce("click_count", F.lit(0)) + F.col("_clicks"))
    return emails.join(log, emails["id"] == log["email_id"], "left").select(
        *[emails[c] for c in emails.columns if c not in ("status", "click_count", *times)],
        F.coalesce("_status", "status").alias("status"),
        clicks.alias("click_count"),
        *[latest(c).alias(c) for c in times],
    )


def fold_email_status(events: DataFrame) -> DataFrame:
    """Final status, clicks and last event per e-mail, in any order of arrival.

    The fold needs no ordered pass. Call acknowledgements and negative events resets: the final
    status is the highest one seen after the last reset, or that of the reset itself. So the latest
    position of the resets and of each of the four forward statuses is enough, and `max` finds these
    with partial aggregation: an e-mail that holds a third of all events shuffles one row per task.
    The same plan runs as a streaming aggregation.
    """
    return status_of(status_state(events))


#: Columns of `status_state`: positions of the last reset and of the last of each forward status, and counters.
STATUS_STATE = (
    "email_id STRING, reset STRUCT<at: TIMESTAMP, event_id: STRING, status: STRING>, "
    + ", ".join(f"{s} STRUCT<at: TIMESTAMP, event_id: STRING>" for s in _FORWARD)
    + ", last_clicked_at TIMESTAMP, last_event_at TIMESTAMP, click_count BIGINT, events BIGINT"
)
_SUMS = ("click_count", "events")


def status_state(events: DataFrame) -> DataFrame:
    """All that the status of an e-mail depends on, one row each; states of different events merge."""
    reset = is_reset()
    here = F.struct("at", "event_id")

    def last(condition: Column) -> Column:
        return F.max(F.when(condition, here))

    return events.groupBy("email_id").agg(
        F.max(F.when(reset, F.struct("at", "event_id", "status"))).alias("reset"),
        *[last(~reset & (F.col("status") == s)).alias(s) for s in _FORWARD],
        F.max(F.when(F.col("kind") == "click", F.col("at"))).alias("last_clicked_at"),
        F.max("at").alias("last_event_at"),
        F.count_if(F.col("kind") == "click").alias("click_count"),
        F.count(F.lit(1)).alias("events"),
    )


def merge_status_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """The state after the events of both, in whatever order they came."""
    both = one.unionByName(other)
    values = [F.sum(c).alias(c) if c in _SUMS else F.max(c).alias(c) for c in both.columns if c != "email_id"]
    return both.groupBy("email_id").agg(*values)


def status_of(folded: DataFrame) -> DataFrame:
    """Final status, clicks and last event per e-mail from its state."""
    floor = F.struct(F.col("reset.at").alias("at"), F.col("reset.event_id").alias("event_id"))
    status = F.coalesce(F.col("reset.status"), F.lit("drafted"))
    for s in _FORWARD:  # the highest comes last and wins
        after = F.col(s).isNotNull() & (F.col("reset").isNull() | (F.col(s) > floor))
        status = F.when(after, s).otherwise(status)
    return folded.select(
        "email_id", status.alias("status"), "click_count", "last_clicked_at", "last_event_at", "events"
    )


def _reached(rank: Column, window: WindowSpec) -> Column:
    """The highest rank in the segment `_seg` of the current row. Segments count upwards, so the
    highest (segment, rank) of the window is in it, and the window needs no order of its own."""
    return F.max(F.col("_seg") * len(STATUS_RANK) + rank).over(window) - F.col("_seg") * len(STATUS_RANK)


def mark_applied(
    events: DataFrame, block_seconds: int = 3600, entered: DataFrame | None = None, block_rows: int = MOST_ROWS
) -> DataFrame:
    """Add `applied`: whether the event changed or confirmed the status at its turn.

    `entered` has the rank that e-mails (`email_id`, `rank`) had reached before.

    This does depend on the order, so events are ranked by a window; to keep the events of one busy
    e-mail from meeting in one task, the window covers one time block of one e-mail, and a busy block is
    cut into parts of about `block_rows` rows. Each block is
    reduced to (has a reset, highest rank after it), these few rows are folded per e-mail, and the
    rank an e-mail enters a block with becomes a first row of that block. No join is needed.
    Events are read four times, for counts, blocks and rows: hand in a table (`session.stored`) rather than the
    joins that make one.
    """
    reset = is_reset()
    ranked = time_blocks(events, "email_id", "at", block_seconds, block_rows).select(
        *events.columns,
        "_block",
        reset.alias("_reset"),
        status_rank(F.col("status")).alias("_rank"),
        F.lit(False).alias("_entry"),
    )
    here = F.struct("at", "event_id")
    blocks = ranked.groupBy("email_id", "_block").agg(
        F.max(F.when(F.col("_reset"), F.struct("at", "event_id", "_rank"))).alias("reset"),
        *[
            F.max(F.when(~F.col("_reset") & (F.col("_rank") == r), here)).alias(f"r{r}")
            for r in sorted(STATUS_RANK.values())
        ],
    )
    floor = F.struct(F.col("reset.at").alias("at"), F.col("reset.event_id").alias("event_id"))
    after_reset = [
        F.when(F.col(f"r{r}").isNotNull() & (F.col("reset").isNull() | (F.col(f"r{r}") > floor)), r)
        for r in sorted(STATUS_RANK.values())
    ]
    tail = F.coalesce(F.greatest(F.col("reset._rank"), *after_reset), F.lit(0))
    by_block = W.partitionBy("email_id").orderBy("_block")
    reached = blocks.select("email_id", "_block", F.col("reset").isNotNull().cast("int").alias("has"), tail.alias("tail"))
    if entered is not None:  # a block before all others
        first = F.lit(-(2**62)).alias("_block")
        reached = reached.unionByName(entered.select("email_id", first, F.lit(0).alias("has"), F.col("rank").alias("tail")))
    entries = (
        reached
        .withColumn("_seg", F.sum("has").over(by_block.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("leaves", _reached(F.col("tail"), by_block.rowsBetween(W.unboundedPreceding, 0)))
        .select(
            "email_id",
            "_block",
            F.lit(True).alias("_reset"),
            F.lag("leaves", 1, 0).over(by_block).alias("_rank"),
            F.lit(True).alias("_entry"),
        )
    )
    order = [F.col("_entry").desc(), F.col("at"), F.col("event_id")]
    in_block = W.partitionBy("email_id", "_block").orderBy(*order)
    current = _reached(F.col("_rank"), in_block.rowsBetween(W.unboundedPreceding, -1))
    return (
        ranked.unionByName(entries, allowMissingColumns=True)
        .withColumn("_seg", F.sum(F.col("_reset").cast("int")).over(in_block.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("applied", F.col("_reset") | (F.col("_rank") >= F.coalesce(current, F.lit(0))))
        .filter(~F.col("_entry"))
        .select(*events.columns, "applied")
    )


def applied_events(events: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Only the events that took effect."""
    return mark_applied(events, block_seconds).filter("applied").drop("applied")


def status_times(events: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Per e-mail the last time each status took effect."""
    statuses = ("sent", "delivered", "bounced", "complained", "failed", "clicked", "replied")
    return (
        applied_events(events, block_seconds)
        .groupBy("email_id")
        .agg(*[F.max(F.when(F.col("status") == s, F.col("at"))).alias(f"{s}_at") for s in statuses])
    )


def event_counters(marked: DataFrame) -> DataFrame:
    """Counters as they grow with the events, from `mark_applied` output with a `campaign_id`.

    Provider events count when they take effect; every reply counts, and every click that was logged,
    whether its e-mail is known or not: use `count_logged_clicks` where the log holds matched ones only.
    """
    provider = (F.col("kind") == "provider") & F.col("applied")
    return marked.groupBy("campaign_id").agg(
        F.count_if(provider & (F.col("status") == "delivered")).alias("emails_delivered"),
        F.count_if(provider & (F.col("status") == "bounced")).alias("emails_bounced"),
        F.count_if(F.col("kind") == "click").alias("emails_clicked"),
        F.count_if(F.col("kind") == "reply").alias("emails_replied"),
    )


def count_logged_clicks(counters: DataFrame, clicks: DataFrame) -> DataFrame:
    """Counters with the clicks of the click log in place of those that found their e-mail."""
    logged = clicks.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("_logged"))
    zero = F.lit(0).cast("long")
    return counters.join(logged, "campaign_id", "full").select(
        "campaign_id",
        *[
            F.coalesce("_logged" if c == "emails_clicked" else c, zero).alias(c)
            for c in counters.columns if c != "campaign_id"
        ],
    )


def ranks_after(events: DataFrame, entered: DataFrame | None = None) -> DataFrame:
    """(email_id, rank) that e-mails have reached after the events, for the next ones to enter with."""
    folded = events.groupBy("email_id").agg(
        F.max(F.when(is_reset(), F.struct("at", "event_id", "status"))).alias("reset"),
        *[F.max(F.when(~is_reset() & (F.col("status") == s), F.struct("at", "event_id"))).alias(s) for s in _FORWARD],
    )
    floor = F.struct(F.col("reset.at").alias("at"), F.col("reset.event_id").alias("event_id"))
    rank = status_rank(F.col("reset.status"))
    for s in _FORWARD:
        after = F.col(s).isNotNull() & (F.col("reset").isNull() | (F.col(s) > floor))
        rank = F.when(after, STATUS_RANK[s]).otherwise(rank)
    new = folded.select("email_id", rank.alias("rank"), F.col("reset").isNotNull().alias("_fresh"))
    if entered is None:
        return new.drop("_fresh")
    old = entered.select("email_id", F.col("rank").alias("_before"))
    return new.join(old, "email_id", "full").select(
        "email_id",
        F.when(F.col("_fresh"), F.col("rank")).otherwise(F.greatest("rank", "_before")).alias("rank"),
    )
