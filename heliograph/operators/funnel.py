"""Funnel analytics: counters per campaign and step, totals, rates and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heliograph.functions.text import js_round, truthy
from heliograph.operators.lifecycle import NEGATIVE
from heliograph.operators.ordering import newest_first

# Fixed value: the share of bounces from which a sender counts as unhealthy.
UNHEALTHY_BOUNCE_SHARE = 0.05

COUNTERS = ("emails_sent", "emails_delivered", "emails_bounced", "emails_clicked", "emails_replied")


def _drafted() -> Column:
    return F.col("status") == "drafted"


def _not_drafted() -> Column:
    """Everything but drafts, rows without a status included."""
    return ~F.coalesce(_drafted(), F.lit(False))


def _delivered() -> Column:
    return F.col("status").isin("delivered", "clicked", "replied")


def _clicked() -> Column:
    return F.col("status").isin("clicked", "replied") | (F.coalesce("click_count", F.lit(0)) > 0)


def _replied() -> Column:
    return F.col("status") == "replied"


def _bounced() -> Column:
    return F.col("status").isin(*NEGATIVE)


def email_counters(emails: DataFrame) -> DataFrame:
    """The five counters per campaign in one pass; `sent` needs a status other than drafted."""
    return emails.groupBy("campaign_id").agg(
        F.count_if(truthy(F.col("status")) & _not_drafted()).alias("emails_sent"),
        F.count_if(_delivered()).alias("emails_delivered"),
        F.count_if(_bounced()).alias("emails_bounced"),
        F.count_if(_clicked()).alias("emails_clicked"),
        F.count_if(_replied()).alias("emails_replied"),
    )


def _per_campaign(campaigns: DataFrame, emails: DataFrame) -> DataFrame:
    """E-mails are counted first, so the join sees one row per campaign on either side."""
    counted = email_counters(emails).withColumnRenamed("campaign_id", "id")
    return campaigns.select("id", "name", "created_at", "leads_imported").join(counted, "id", "left").select(
        "id", "name", "created_at", "leads_imported",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS],
    )


def campaign_summary(campaigns: DataFrame, emails: DataFrame, limit: int | None = 50) -> DataFrame:
    """Counters of the newest campaigns, or of all without a limit. Campaigns without e-mails show zeros."""
    return newest_first(_per_campaign(campaigns, emails), "created_at", limit)


def outreach_totals(campaigns: DataFrame, emails: DataFrame) -> DataFrame:
    """The counters over all existing campaigns, in one row even without any."""
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return _per_campaign(campaigns, emails).agg(
        F.count(F.lit(1)).alias("campaigns"),
        total("leads_imported").alias("leads"),
        *[total(c).alias(c.removeprefix("emails_")) for c in COUNTERS],
    )


def funnel_rates(counters: DataFrame, prefix: str = "emails_") -> DataFrame:
    """Whole percentages of the sent e-mails, null without any, and the bounce alarm.

    The totals carry the same counters without a prefix.
    """
    sent = F.col(f"{prefix}sent")

    def pct(c: str) -> Column:
        return F.when(sent != 0, js_round(F.col(f"{prefix}{c}") / sent * 100))

    return (
        counters.withColumn("delivery_rate", pct("delivered"))
        .withColumn("click_rate", pct("clicked"))
        .withColumn("reply_rate", pct("replied"))
        .withColumn("bounce_rate", pct("bounced"))
        .withColumn(
            "unhealthy",
            F.col(f"{prefix}bounced") / F.greatest(F.lit(1), sent) >= UNHEALTHY_BOUNCE_SHARE,
        )
    )


def campaign_counters(leads: DataFrame, emails: DataFrame) -> DataFrame:
    """Counters of the campaign page, leads included; here a missing status counts as sent.

    Both tables go through a single aggregation, with no join.
    """
    people = leads.select(
        "campaign_id",
        F.lit(1).alias("is_lead"),
        truthy(F.col("email")).cast("int").alias("has_email"),
    )
    flags = {
        "drafts": _drafted(), "sent": _not_drafted(), "delivered": _delivered(),
        "bounced": _bounced(), "clicked": _clicked(), "replied": _replied(),
    }
    mails = emails.select(
        "campaign_id",
        *[F.coalesce(flag, F.lit(False)).cast("int").alias(name) for name, flag in flags.items()],
    )
    both = people.unionByName(mails, allowMissingColumns=True)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return both.groupBy("campaign_id").agg(
        total("is_lead").alias("leads"),
        total("has_email").alias("leads_with_email"),
        *[total(name).alias(name) for name in flags],
    )


#: Longest gap between two steps of a campaign that is filled with empty steps.
MOST_GAP = 10_000


def step_stats(emails: DataFrame) -> DataFrame:
    """Counters per campaign and step, for every step from 1 to the campaign's last.

    The label of a step is the framework of its newest e-mail, found inside the same aggregation. Empty
    steps are made from the distance to the step before, so one pass is enough; of a gap of more than MOST_GAP
    steps the last ones are filled: a draft numbered two billion doesn't make as many rows. Steps below 1 count
    nowhere, but their campaign has a first step.
    """
    step = F.coalesce("sequence_position", F.lit(1))
    counts = {"drafted": _drafted(), "sent": _not_drafted(), "delivered": _delivered(), "clicked": _clicked(), "replied": _replied()}
    by_step = emails.groupBy("campaign_id", F.greatest(step, F.lit(1)).alias("_step")).agg(
        *[F.count_if((step >= 1) & flag).alias(name) for name, flag in counts.items()],
        F.max(F.when(step >= 1, F.struct("created_at", "id", "framework"))).alias("_newest"),
    )
    campaign = W.partitionBy("campaign_id")
    before = F.coalesce(F.lag("_step").over(campaign.orderBy("_step")), F.lit(0))
    first = F.greatest(before + 1, F.col("_step") - MOST_GAP)
    spread = by_step.withColumn("max_step", F.max("_step").over(campaign)).withColumn("step", F.sequence(first, "_step")).withColumn("step", F.explode("step"))
    own = F.col("step") == F.col("_step")
    return spread.select(
        "campaign_id", "step", *[F.when(own, F.col(c)).otherwise(0).alias(c) for c in counts],
        F.when(own, F.col("_newest.framework")).alias("framework"),
        (F.col("max_step") > 1).alias("is_sequence"),
    )


def step_gate(stats: DataFrame) -> DataFrame:
    """Which steps may be sent: drafts wait, and it is the first step or the one before went out."""
    by_step = W.partitionBy("campaign_id").orderBy("step")
    before = F.lag("sent").over(by_step)
    return stats.withColumn(
        "sendable",
        (F.col("drafted") > 0) & ((F.col("step") == 1) | (F.coalesce(before, F.lit(0)) > 0)),
    )


def counter_drift(campaigns: DataFrame, emails: DataFrame) -> DataFrame:
    """Cached counters less derived ones."""
    derived = email_counters(emails).withColumnRenamed("campaign_id", "id")
    for c in COUNTERS:
        derived = derived.withColumnRenamed(c, f"_{c}")
    drift = []
    for c in COUNTERS:
        cached, counted = F.coalesce(c, F.lit(0)), F.coalesce(f"_{c}", F.lit(0))
        drift += [
            cached.alias(c.replace("emails", "cached")),
            counted.alias(c.replace("emails", "derived")),
            (cached - counted).alias(c.replace("emails", "drift")),
        ]
    return campaigns.join(derived, "id", "left").select("id", *drift)


def flywheel_totals(campaigns: DataFrame) -> DataFrame:
    """Sums of the cached counters."""
    sources = {
        "leads": "leads_imported", "emails": "emails_sent", "clicks": "emails_clicked", "replies": "emails_replied",
    }
    return campaigns.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sources.items()])


def campaign_card(campaigns: DataFrame) -> DataFrame:
    """The short form of a campaign."""
    zero = ("leads_imported", "emails_sent", "emails_delivered", "emails_clicked", "emails_replied")
    return campaigns.select(
        "name", "status", "query",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        F.coalesce("default_framework", F.lit("one-off")).alias("framework"),
        "created_at",
    )
