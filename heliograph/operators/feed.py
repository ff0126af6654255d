"""The activity feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.keys import lookup_key, spread_key
from heliograph.functions.text import truthy

# Feed categories, the stand-in emoji, and how the live feed behaves.
CATEGORIES = ("task", "research", "email", "content", "decision", "error", "system")
DEFAULT_EMOJI = "⚡"
LIVE_ROWS = 20
REMEMBERED_ROWS = 5
ACTIVE_SECONDS = 60

# The ids that lead somewhere.
LINKED_IDS = ("campaign_id", "reply_id", "slug", "task_id", "session_id", "invitation_id")

FEED_COLUMNS = ("id", "agent_id", "category", "summary", "details", "created_at")


def _entry(
    df: DataFrame, source: str, category: str, summary: Column, details: dict[str, str], at: str,
    agent: Column | None = None, keep_nulls: bool = False,
) -> DataFrame:
    """One feed row per input row; the id says where it came from."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    payload = F.to_json(F.struct(*[F.col(c).alias(name) for name, c in details.items()]), options) if details else F.lit(None)
    return df.select(
        F.concat(F.lit(f"{source}-"), F.col("id")).alias("id"),
        (agent if agent is not None else F.lit(None)).cast("string").alias("agent_id"),
        F.lit(category).alias("category"),
        summary.alias("summary"),
        payload.cast("string").alias("details"),
        F.col(at).alias("created_at"),
    )


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Fixed values, in all sources below: the summaries and the keys of the details, which users and
# `route_activity` match on.
def from_log(activity: DataFrame) -> DataFrame:
    """Rows that agents logged themselves."""
    return activity.select(*FEED_COLUMNS)


def from_webhook_events(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    hooks = webhooks.select(F.col("id").alias("webhook_id"), "name", F.coalesce("service", F.lit("generic")).alias("service"))
    named = events.join(hooks, "webhook_id")
    summary = _text('Webhook "', F.col("name"), '" received an event')
    return _entry(named, "webhook", "system", summary, {"event_id": "id", "service": "service"}, "received_at")


def from_replies(replies: DataFrame) -> DataFrame:
    summary = _text(
        "Reply from ", F.coalesce("from", F.lit("unknown")), ": ",
        F.substring(F.coalesce("subject", F.lit("(no subject)")), 1, 80),
    )
    details = {"reply_id": "id", "campaign_id": "campaign_id"}
    return _entry(replies, "reply", "email", summary, details, "received_at", keep_nulls=True)


def from_clicks(clicks: DataFrame, campaigns: DataFrame) -> DataFrame:
    names = campaigns.select(F.col("id").alias("campaign_id"), "name")
    named = clicks.join(names, "campaign_id", "left")
    summary = _text("Link clicked in campaign ", F.coalesce("name", "campaign_id"))
    details = {"campaign_id": "campaign_id", "email_id": "email_id", "url": "url"}
    return _entry(named, "click", "email", summary, details, "clicked_at")


def from_submissions(submissions: DataFrame) -> DataFrame:
    summary = _text('Form "', F.col("form_slug"), '" received a submission')
    return _entry(submissions, "submission", "system", summary, {"submission_id": "id", "data": "data"}, "received_at")


def from_new_tasks(tasks: DataFrame) -> DataFrame:
    summary = _text('Task created: "', F.col("title"), '"')
    return _entry(tasks, "task", "task", summary, {}, "created_at", F.col("assignee_id"))


def from_task_moves(moves: DataFrame) -> DataFrame:
    summary = _text('Task "', F.col("title"), '" → ', F.col("status"))
    return _entry(moves, "move", "task", summary, {}, "updated_at", F.col("assignee_id"))


def from_converted_replies(tasks: DataFrame) -> DataFrame:
    """Tasks made from replies."""
    summary = _text(F.col("title"), " converted to task")
    return _entry(tasks, "convert", "decision", summary, {"task_id": "id", "reply_id": "reply_id"}, "created_at")


def from_new_agents(agents: DataFrame) -> DataFrame:
    summary = _text('Agent "', F.col("name"), '" registered as @', F.col("sign_in_name"))
    return _entry(agents, "agent", "system", summary, {}, "created_at", F.col("id"))


def from_deleted_agents(deletions: DataFrame) -> DataFrame:
    summary = _text("Agent ", F.col("id"), " deleted")
    return _entry(deletions, "agent-deleted", "system", summary, {}, "deleted_at")


def from_sessions(summaries: DataFrame) -> DataFrame:
    """Output of the session summary, dated at the end of the session."""
    return _entry(summaries, "session", "system", F.col("summary"), {"session_id": "id"}, "ended_at")


def from_invitations(invitations: DataFrame) -> DataFrame:
    summary = _text(F.col("agent_name"), " wants to talk: ", F.substring("reason", 1, 80))
    return _entry(
        invitations, "invitation", "decision", summary, {"invitation_id": "id"}, "created_at", F.col("agent_id")
    )


def from_new_pages(pages: DataFrame) -> DataFrame:
    summary = _text('Landing page "', F.col("title"), '" published at /p/', F.col("slug"))
    details = {"slug": "slug", "linked_form_slug": "linked_form_slug"}
    return _entry(pages.withColumn("id", F.col("slug")), "page", "content", summary, details, "created_at")


def from_page_updates(updates: DataFrame) -> DataFrame:
    """`(id, slug, title, changed, updated_at)`, where `changed` lists the fields of a patch."""
    changed = F.when(F.size("changed") > 0, F.array_join("changed", ", ")).otherwise("no fields")
    summary = _text('Landing page "', F.coalesce("title", "slug"), '" updated (', changed, ")")
    return _entry(updates, "page-update", "content", summary, {"slug": "slug", "changed": "changed"}, "updated_at")


def from_new_campaigns(campaigns: DataFrame) -> DataFrame:
    summary = _text('Outreach campaign created: "', F.col("name"), '"')
    return _entry(campaigns, "campaign", "content", summary, {"campaign_id": "id", "query": "query"}, "created_at")


def from_scrape_starts(runs: DataFrame) -> DataFrame:
    """`(id, campaign_id, name, apify_run_id, started_at)`."""
    summary = _text('Apify run started for "', F.col("name"), '"')
    details = {"campaign_id": "campaign_id", "apify_run_id": "apify_run_id"}
    return _entry(runs, "scrape-start", "research", summary, details, "started_at")


def from_scrape_imports(imports: DataFrame) -> DataFrame:
    """`(id, campaign_id, name, imported, finished_at)`."""
    summary = _text(
        "Apify scrape complete: ", F.col("imported").cast("string"), ' leads imported for "', F.col("name"), '"'
    )
    details = {"campaign_id": "campaign_id", "imported": "imported"}
    return _entry(imports, "scrape", "research", summary, details, "finished_at")


def from_test_leads(leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    names = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("_campaign"))
    summary = _text('Test lead added to campaign "', F.col("_campaign"), '": ', F.col("email"))
    details = {"campaign_id": "campaign_id", "lead_id": "id"}
    return _entry(leads.filter("is_test").join(names, "campaign_id"), "lead", "system", summary, details, "created_at")


def from_agent_drafts(emails: DataFrame) -> DataFrame:
    """Drafts that agents wrote themselves."""
    drafts = (
        emails.filter(F.col("source") == "agent_drafted")
        .withColumn("framework", F.coalesce("framework", F.lit("one-off")))
        .withColumn("sequence_position", F.coalesce("sequence_position", F.lit(1)))
        .withColumn("sequence_total", F.coalesce("sequence_total", "sequence_position"))
    )
    summary = _text(
        "Agent drafted email (", F.col("framework"), " step ", F.col("sequence_position").cast("string"), "/",
        F.col("sequence_total").cast("string"), ") for ", F.col("to_name"),
    )
    details = {
        "campaign_id": "campaign_id", "lead_id": "lead_id", "email_id": "id",
        "framework": "framework", "step": "sequence_position",
    }
    return _entry(drafts, "draft", "content", summary, details, "created_at")


def from_draft_batches(batches: DataFrame) -> DataFrame:
    """`(id, campaign_id, name, generated, errors, finished_at)`."""
    summary = _text("Drafted ", F.col("generated").cast("string"), ' emails for "', F.col("name"), '"')
    details = {"campaign_id": "campaign_id", "generated": "generated", "errors": "errors"}
    return _entry(batches, "drafts", "content", summary, details, "finished_at")


def from_send_runs(runs: DataFrame) -> DataFrame:
    """`(id, campaign_id, name, sent, total, errors, finished_at)`."""
    summary = _text(
        "Sent ", F.col("sent").cast("string"), " of ", F.col("total").cast("string"),
        ' emails for "', F.col("name"), '"',
    )
    details = {"campaign_id": "campaign_id", "sent": "sent", "errors": "errors"}
    return _entry(runs, "send", "email", summary, details, "finished_at")


def activity_feed(*sources: DataFrame) -> DataFrame:
    """One feed from any of the sources above; tables or streams."""
    return reduce(DataFrame.unionByName, sources)


def category_or_default(c: Column) -> Column:
    return F.when(c.isin(*CATEGORIES), c).otherwise("system")


def route_activity(activity: DataFrame) -> DataFrame:
    """Add the dashboard route an entry leads to; the first id that is there decides."""
    ids = F.from_json("details", ", ".join(f"{name} STRING" for name in LINKED_IDS))

    def has(name: str) -> Column:
        return truthy(F.col(f"_ids.{name}"))

    on_page = has("slug") & (F.col("category") == "content")
    route = (
        F.when(has("campaign_id"), F.concat(F.lit("/outreach/"), F.col("_ids.campaign_id")))
        .when(has("reply_id"), "/inbox")
        .when(on_page & F.lower("summary").contains("landing page"), "/pages")
        .when(on_page, F.concat(F.lit("/forms/"), F.col("_ids.slug")))
        .when(has("task_id"), "/tasks")
        .when(has("session_id") | has("invitation_id"), "/voice")
    )
    return activity.withColumn("_ids", ids).withColumn("route", route).drop("_ids")


def activity_with_agent(activity: DataFrame, agents: DataFrame) -> DataFrame:
    """Feed rows with their agent's emoji. Most rows have no agent and do not meet on one key."""
    faces = agents.select(lookup_key(F.col("id")).alias("_agent"), F.col("emoji").alias("_emoji"))
    return (
        activity.withColumn("_agent", spread_key(F.col("id"), F.col("agent_id")))
        .join(faces, "_agent", "left")
        .select(*activity.columns, F.coalesce("_emoji", F.lit(DEFAULT_EMOJI)).alias("emoji"))
    )


def dedupe_feed(feed: DataFrame, n: int = LIVE_ROWS) -> DataFrame:
    """The live list: the newest n ids, one row each, newest first.

    Of equal ids the older row stays; of equally old ones the one whose values sort first. Rows of an id
    combine before the shuffle.
    """
    place = F.struct("created_at", "summary", "category", "agent_id", "details")
    kept = feed.groupBy("id").agg(F.min(place).alias("_r"))
    rows = kept.select(*[F.col(c) if c == "id" else F.col(f"_r.{c}").alias(c) for c in FEED_COLUMNS])
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(n)


def flag_new_entries(feed: DataFrame, seen: DataFrame) -> DataFrame:
    """The newest row if its id is not among the seen ones."""
    top = feed.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(1)
    return top.join(seen.select("id").distinct(), "id", "left_anti")


def remembered_ids(feed: DataFrame) -> DataFrame:
    """Ids to add to the seen ones after a flash."""
    return feed.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(REMEMBERED_ROWS).select("id")


def feed_active(feed: DataFrame, now: Column) -> DataFrame:
    """One row: whether the newest entry is younger than a minute."""
    age = F.unix_micros(now) - F.unix_micros(F.max("created_at"))
    return feed.agg(
        F.max("created_at").alias("newest_at"),
        F.coalesce(age < ACTIVE_SECONDS * 1_000_000, F.lit(False)).alias("active"),
    )
