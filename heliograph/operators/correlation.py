"""Matching provider events, replies and clicks with the e-mails they belong to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.keys import lookup_key, spread_key
from heliograph.functions.text import truthy

# Provider event types and the statuses they stand for.
OUTBOUND_STATUS = {
    "message.sent": "sent",
    "message.delivered": "delivered",
    "message.bounced": "bounced",
    "message.complained": "complained",
    "message.rejected": "failed",
}
INBOUND_REPLY = "message.received"
CARRIERS = ("send", "delivery", "bounce", "complaint", "rejection")
PROVIDER_SERVICE = "agentmail"
PROVIDER_PREFIX = "message."


def extract_message_ids(events: DataFrame, event: str = "event") -> DataFrame:
    """Add `message_id` and `thread_id`, both from the first carrier that has either one."""
    pairs = []
    for carrier in CARRIERS:
        m, t = F.col(f"{event}.{carrier}.message_id"), F.col(f"{event}.{carrier}.thread_id")
        pairs.append(F.when(truthy(m) | truthy(t), F.struct(m.alias("message_id"), t.alias("thread_id"))))
    return (
        events.withColumn("_ids", F.coalesce(*pairs))
        .withColumn("message_id", F.col("_ids.message_id"))
        .withColumn("thread_id", F.col("_ids.thread_id"))
        .drop("_ids")
    )


def route_events(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Events for the mail pipeline: by the tag of their webhook or by the look of their type.

    Events of unknown webhooks are refused.
    """
    tags = webhooks.select(F.col("id").alias("webhook_id"), "service")
    looks = F.coalesce(F.col("event.event_type").startswith(PROVIDER_PREFIX), F.lit(False))
    tagged = F.coalesce(F.col("service") == PROVIDER_SERVICE, F.lit(False))
    return events.join(tags, "webhook_id").filter(tagged | looks).drop("service")


def classify_event(events: DataFrame, event_type: Column | None = None) -> DataFrame:
    """Add `status` and keep outbound lifecycle events only; unknown types are ignored."""
    kind = event_type if event_type is not None else F.col("event.event_type")
    status = F.lit(None).cast("string")
    for name, value in OUTBOUND_STATUS.items():
        status = F.when(kind == name, value).otherwise(status)
    return events.withColumn("status", status).filter(F.col("status").isNotNull())


FOUND = "STRUCT<campaign_id: STRING, created_at: TIMESTAMP, email_id: STRING, lead_id: STRING>"


def first_emails(emails: DataFrame, id_column: str) -> DataFrame:
    """(provider_id, hit): the first e-mail in store order under each id of the provider. Combines before
    the shuffle, and so does `merge_first_emails` of what was found before and what is new."""
    first = F.min(
        F.struct("campaign_id", "created_at", F.col("id").alias("email_id"), "lead_id")
    )
    return emails.filter(truthy(F.col(id_column))).groupBy(F.col(id_column).alias("provider_id")).agg(first.alias("hit"))


def merge_first_emails(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("provider_id").agg(F.min("hit").alias("hit"))


def _found(first: DataFrame, key: str, hit: str) -> DataFrame:
    return first.select(lookup_key(F.col("provider_id")).alias(key), F.col("hit").alias(hit))


def correlate_events(events: DataFrame, emails: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """`(id, message_id, thread_id, …)` to the first e-mail with either id, in store order.

    "Either id" is two equality joins and the smaller of their hits, never an OR join. Each join
    looks up a table with one row per id, so a busy thread on both sides makes no pairs and the
    event side may be split freely when skewed. Events without an id do not pile up on one key.
    """
    return match_events(
        events, first_emails(emails, "agentmail_message_id"), first_emails(emails, "agentmail_thread_id"), keep_unmatched
    )


def match_events(events: DataFrame, by_message: DataFrame, by_thread: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """The same with the first e-mails by message and by thread already found."""
    by_message, by_thread = _found(by_message, "_message", "_m"), _found(by_thread, "_thread", "_t")
    joined = (
        events.withColumn("_message", spread_key(F.col("id"), F.col("message_id")))
        .withColumn("_thread", spread_key(F.col("id"), F.col("thread_id")))
        .join(by_message, "_message", "left")
        .join(by_thread, "_thread", "left")
        .withColumn("_hit", F.least("_m", "_t"))
    )
    if not keep_unmatched:
        joined = joined.filter(F.col("_hit").isNotNull())
    return joined.select(
        *events.columns,
        F.col("_hit.email_id").alias("email_id"),
        F.col("_hit.campaign_id").alias("campaign_id"),
        F.col("_hit.lead_id").alias("lead_id"),
    )


def correlate_replies(replies: DataFrame, emails: DataFrame) -> DataFrame:
    """Replies to e-mails by thread alone. Unmatched ones stay, in the `unassigned` partition."""
    return match_replies(replies, first_emails(emails, "agentmail_thread_id"))


def match_replies(replies: DataFrame, by_thread: DataFrame) -> DataFrame:
    """The same with the first e-mails by thread already found."""
    by_thread = _found(by_thread, "_thread", "_t")
    return (
        replies.withColumn("_thread", spread_key(F.col("id"), F.col("agentmail_thread_id")))
        .join(by_thread, "_thread", "left")
        .select(
            *replies.columns,
            F.col("_t.campaign_id").alias("campaign_id"),
            F.col("_t.lead_id").alias("lead_id"),
            F.col("_t.email_id").alias("original_email_id"),
            F.coalesce("_t.campaign_id", F.lit("unassigned")).alias("partition"),
            F.lit(False).alias("handled"),
        )
    )


def extract_replies(calls: DataFrame) -> DataFrame:
    """Stored webhook calls to inbound replies, as `correlate_replies` takes them.

    A reply is as old as its mail says (`received_at`), or as its call where the mail doesn't say, but it
    takes effect when its call arrives (`arrived_at`).
    """
    message = F.col("event.message")
    sent = F.try_to_timestamp(message["timestamp"])
    return calls.filter((F.col("event.event_type") == INBOUND_REPLY) & message.isNotNull()).select(
        F.concat(F.lit("reply-"), F.col("id")).alias("id"),
        message["message_id"].alias("agentmail_message_id"),
        message["thread_id"].alias("agentmail_thread_id"),
        *[message[c].alias(c) for c in ("from", "to", "subject", "text", "html")],
        F.coalesce(sent, F.col("received_at")).alias("received_at"),
        F.col("received_at").alias("arrived_at"),
    )


def attribute_clicks(clicks: DataFrame, emails: DataFrame) -> DataFrame:
    """Clicks with the e-mail they belong to, by campaign and id; the others stay in the log."""
    known = emails.select(
        "campaign_id", F.col("id").alias("email_id"), F.col("status").alias("_before"), F.lit(True).alias("_known")
    )
    after = F.when(F.col("_before") == "replied", "replied").otherwise("clicked")
    return clicks.join(known, ["campaign_id", "email_id"], "left").select(
        *clicks.columns,
        F.col("_known").isNotNull().alias("matched"),
        F.when(F.col("_known"), after).alias("status_after"),
    )


def click_stats(clicks: DataFrame) -> DataFrame:
    """Clicks and the last click per e-mail."""
    return clicks.groupBy("email_id").agg(
        F.count(F.lit(1)).alias("click_count"), F.max("clicked_at").alias("last_clicked_at")
    )


def with_click_stats(emails: DataFrame, clicks: DataFrame) -> DataFrame:
    """E-mails with their click counters."""
    stats = click_stats(clicks).withColumnRenamed("email_id", "id")
    return emails.drop("click_count", "last_clicked_at").join(stats, "id", "left")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_id: str = "id") -> DataFrame:
    """Rows that name a parent which is gone."""
    known = parents.select(F.col(parent_id).alias(key))
    return children.filter(truthy(F.col(key).cast("string"))).join(known, key, "left_anti")


#: What names what: child kind, column, parent kind; parents come before their children.
CHILD_LINKS = (
    ("leads", "campaign_id", "campaigns"),
    ("emails", "campaign_id", "campaigns"),
    ("emails", "lead_id", "leads"),
    ("replies", "campaign_id", "campaigns"),
    ("replies", "original_email_id", "emails"),
    ("clicks", "email_id", "emails"),
    ("webhook_events", "webhook_id", "webhooks"),
    ("agent_keys", "agent_id", "agents"),
)


def orphan_sweep(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str]] = CHILD_LINKS) -> DataFrame:
    """(kind, id, cause) of all rows that a deletion leaves without a parent, on every level: a row goes if
    it names a parent that isn't there or that goes itself. `cause` is the kind of the first such parent.

    Each level is looked up in what stays of the one above, by equality joins with one row per parent, so a
    parent with most of the children may be split. Rows that name no parent stay.
    """
    staying, swept = dict(tables), []
    for kind in dict.fromkeys(child for child, _, _ in links):
        rows, cause = tables[kind].withColumn("_row", F.col("id").cast("string")), []
        for n, (_, key, parent) in enumerate(link for link in links if link[0] == kind):
            known = staying[parent].select(lookup_key(F.col("id")).alias(f"_k{n}"), F.lit(True).alias(f"_there{n}"))
            rows = rows.withColumn(f"_k{n}", spread_key(F.col("_row"), F.col(key))).join(known, f"_k{n}", "left")
            cause.append(F.when(truthy(F.col(key).cast("string")) & F.col(f"_there{n}").isNull(), parent))
        rows = rows.withColumn("_cause", F.coalesce(*cause))
        staying[kind] = rows.filter(F.col("_cause").isNull()).select(*tables[kind].columns)
        swept.append(rows.filter(F.col("_cause").isNotNull()).select(F.lit(kind).alias("kind"), F.col("_row").alias("id"), F.col("_cause").alias("cause")))
    return reduce(DataFrame.unionByName, swept)


def delivery_key() -> Column:
    """What deliveries of one event have in common; calls without an event are by themselves."""
    return F.coalesce("event_id", F.concat(F.lit("\u0000"), F.col("id")))


def dedupe_deliveries(events: DataFrame, at: str = "received_at") -> DataFrame:
    """Drop redelivered provider events by their `event_id`; optional, off in the default pipeline.

    On a table the first delivery of an event stays, on a stream the one that comes in first. A stream
    remembers every id in its state store, on disk: a call that comes late is only dropped if its event was
    seen, never for its age. `streaming.jobs.redelivery_filter` keeps the ids in tables instead.
    """
    keyed = events.withColumn("_delivery", delivery_key())
    if events.isStreaming:
        return keyed.dropDuplicates(["_delivery"]).drop("_delivery")
    first = F.min_by(F.struct(*events.columns), F.struct(at, "id"))
    return keyed.groupBy("_delivery").agg(first.alias("_r")).select("_r.*")
