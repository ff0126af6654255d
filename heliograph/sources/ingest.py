"""Raw requests, tokens and scraped items to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.json import is_json
from heliograph.functions.rows import computed_once
from heliograph.functions.text import truthy
from heliograph.functions.tokens import token_characters, token_payload, token_text
from heliograph.operators.leads import normalize_leads
from heliograph.operators.ordering import top_per_group
from heliograph.schemas import PROVIDER_EVENT_DDL


def parse_webhook_events(
    raw: DataFrame, received_at: Column | None = None, webhooks: DataFrame | None = None
) -> DataFrame:
    """`(id, webhook_id, headers, raw_body)` to stored events.

    A body that is JSON is parsed; any other body is kept as text. With `webhooks`, calls to unknown
    ones are refused. Works on tables and streams.
    """
    if webhooks is not None:
        raw = raw.join(webhooks.select(F.col("id").alias("webhook_id")), "webhook_id", "left_semi")
    ok = is_json(F.col("raw_body"))
    stamp = received_at if received_at is not None else F.col("received_at")
    checked = raw.withColumn("_ok", ok)
    parsed = computed_once(checked, _event=F.when(F.col("_ok"), F.from_json("raw_body", PROVIDER_EVENT_DDL)))
    return parsed.select(
        "id",
        "webhook_id",
        "headers",
        F.nullif("raw_body", F.lit("")).alias("body"),
        F.col("_ok").alias("is_json"),
        F.col("_event").alias("event"),
        stamp.alias("received_at"),
    )


def decode_click_tokens(tokens: DataFrame) -> DataFrame:
    """`token` plus carried columns to clicks. A token without a target address is rejected;
    `logged` tells whether it names both a campaign and an e-mail and so counts as a click."""
    texts = (
        tokens.withColumn("_kept", token_characters(F.col("token")))
        .withColumn("_text", token_text(F.col("_kept")))
    )
    return (
        computed_once(texts, _p=token_payload(F.col("_text")))
        .filter(truthy(F.col("_p.u")))
        .select(
            *[c for c in tokens.columns if c != "token"],
            F.col("_p.c").alias("campaign_id"),
            F.col("_p.l").alias("lead_id"),
            F.col("_p.e").alias("email_id"),
            F.col("_p.u").alias("url"),
            (truthy(F.col("_p.c")) & truthy(F.col("_p.e"))).alias("logged"),
        )
    )


def parse_submissions(raw: DataFrame, forms: DataFrame) -> DataFrame:
    """`(id, form_slug, body, received_at)` to submissions of existing forms.

    Required fields are not enforced. A missing body is an empty submission, a broken one is refused.
    """
    posted = computed_once(raw, _body=F.coalesce(F.col("body"), F.lit("{}")))
    known = forms.select(F.col("slug").alias("form_slug"))
    return (
        posted.filter(is_json(F.col("_body")))
        .join(known, "form_slug", "left_semi")
        .select("id", "form_slug", F.from_json("_body", "map<string,string>").alias("data"), "received_at")
    )


# Fixed value: no search plan asks for more results than this.
MOST_RESULTS = 200


def import_scraped_leads(raw: DataFrame, campaigns: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """`(campaign_id, item_no, item)` to new leads, at most `maxResults` per campaign's plan.

    The first items win. Plans are clamped to `most`, so Spark can cut each task's items per campaign to
    that many before the shuffle. Each campaign's own limit follows.
    """
    limits = campaigns.select(
        F.col("id").alias("campaign_id"), F.col("structured_query.maxResults").alias("_limit")
    )
    first = top_per_group(raw, ["campaign_id"], ["item_no", "item"], most)
    kept = first.join(limits, "campaign_id").filter("_rn <= _limit")
    return normalize_leads(kept).select(
        F.concat_ws("-", F.lit("lead"), F.col("campaign_id"), F.col("_rn").cast("string")).alias("id"),
        "campaign_id", "name", "email", "phone", "website", "address", "category", "rating",
        "reviews_count", "maps_url",
        F.col("item").alias("raw"),
        F.lit("new").alias("status"),
        F.lit(False).alias("is_test"),
        F.array().cast("array<string>").alias("tags"),
    )
