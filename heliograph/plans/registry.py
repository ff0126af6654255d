"""The registered queries: every operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, TimestampType

from heliograph.functions import html, text
from heliograph.operators import (
    boards, correlation, feed, funnel, leads, lifecycle, ordering, pages, sequence, sessions, snapshots,
)
from heliograph.plans import views as v
from heliograph.session import configure, scratch_path, stored
from heliograph.sources import entities, ingest
from heliograph.streaming import jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Most that one streaming micro-batch reads.
STREAM_BATCH_BYTES = 256 * 1024 * 1024


def query(fn: Query) -> Query:
    """Register a query under its function name; results carry plain columns only."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _plain(fn(configure(spark), sf))

    QUERIES[fn.__name__] = run
    return fn


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone and arrays as JSON, so that any engine can compare them."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, ArrayType):
            c = F.to_json(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


# --- sources ---------------------------------------------------------------------------------------

def _webhook_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_webhook_events(v.raw_webhook_calls(v.table(spark, sf, "events")))


@query
def parse_webhook_events(spark, sf):
    return _webhook_events(spark, sf).select(
        "id", "webhook_id", "is_json", F.col("event.event_type").alias("event_type"),
        F.element_at("headers", "user-agent").alias("agent"), "body", "received_at",
    )


@query
def decode_click_tokens(spark, sf):
    return ingest.decode_click_tokens(v.click_tokens(v.table(spark, sf, "lineitem")))


def _submissions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_submissions(v.raw_submissions(v.table(spark, sf, "events")), v.forms(spark, sf))


@query
def parse_submissions(spark, sf):
    return _submissions(spark, sf).select(
        "id", "form_slug", F.try_element_at("data", F.lit("k")).alias("k"),
        F.try_element_at("data", F.lit("e_mail")).alias("e_mail"), "received_at",
    )


@query
def import_scraped_leads(spark, sf):
    return ingest.import_scraped_leads(v.scraped_items(spark, sf), v.campaigns(spark, sf)).drop("raw", "tags")


@query
def stored_round_trip(spark, sf):
    """Clicks written under their campaign, half of them by a run that is repeated, read back for one campaign
    whose id looks like a number."""
    clicks, path = v.clicks(spark, sf), scratch_path(spark, "clicks")
    clicks = clicks.withColumn("campaign_id", F.concat(F.lit("00"), F.col("campaign_id")))
    odd = F.col("email_id").cast("bigint") % 2 == 1
    for part, run in ((~odd, "even"), (odd, "odd"), (odd, "odd")):
        entities.write_partitioned(clicks.filter(part), path, "campaign_id", run_id=run)
    return entities.read_entity(spark, path, "clicks", partition="007").select("id", "campaign_id", "email_id", "clicked_at")


@query
def newest_stored(spark, sf):
    """The newest e-mails of a store by days, of which only the last are opened."""
    mails, path = v.emails(spark, sf).select("id", "campaign_id", "created_at"), scratch_path(spark, "mails")
    months = mails.withColumn("created_at", F.date_trunc("month", "created_at"))
    entities.write_clustered(months, path, "created_at", "first")
    return entities.newest_stored(spark, path, months.schema, "created_at", 100)


@query
def lookup(spark, sf):
    """One e-mail by its id, from a store in which only the row groups that may hold it are read."""
    mails, path = v.emails(spark, sf).select("id", "campaign_id", "created_at"), scratch_path(spark, "mails")
    entities.write_clustered(mails.withColumn("created_at", F.date_trunc("year", "created_at")), path, "created_at", "first")
    return entities.lookup(entities.read_clustered(spark, path, mails.schema), "7")


# --- leads and plans -------------------------------------------------------------------------------

@query
def normalize_leads(spark, sf):
    return leads.normalize_leads(v.scraped_items(spark, sf)).drop("item")


@query
def lead_count(spark, sf):
    return leads.lead_count(v.leads(spark, sf))


@query
def normalize_search_plan(spark, sf):
    return leads.normalize_search_plan(v.search_plans(spark, sf)).drop("query")


@query
def extract_contact_emails(spark, sf):
    return leads.extract_contact_emails(v.crawl(spark, sf), other_pages=True)


@query
def extract_contact_emails_known_paths(spark, sf):
    return leads.extract_contact_emails(v.crawl(spark, sf))


@query
def enrich_leads(spark, sf):
    contacts = leads.extract_contact_emails(v.crawl(spark, sf), other_pages=True)
    return leads.enrich_leads(v.leads(spark, sf), contacts).select("id", "email", "enriched", "reason")


@query
def enrichment_report(spark, sf):
    contacts = leads.extract_contact_emails(v.crawl(spark, sf), other_pages=True)
    return leads.enrichment_report(leads.enrich_leads(leads.enrichable_leads(v.leads(spark, sf)), contacts))


# --- events ----------------------------------------------------------------------------------------

@query
def extract_message_ids(spark, sf):
    events = correlation.extract_message_ids(_webhook_events(spark, sf))
    return events.select("id", "message_id", "thread_id")


@query
def route_events(spark, sf):
    return correlation.route_events(_webhook_events(spark, sf), v.webhooks(spark, sf)).select(
        "id", "webhook_id", F.col("event.event_type").alias("event_type")
    )


@query
def classify_event(spark, sf):
    return correlation.classify_event(_webhook_events(spark, sf)).select("id", "status")


@query
def correlate_events(spark, sf):
    return correlation.correlate_events(v.provider_events(spark, sf), v.emails(spark, sf))


@query
def correlate_replies(spark, sf):
    return correlation.correlate_replies(v.replies(spark, sf), v.emails(spark, sf)).select(
        "id", "campaign_id", "lead_id", "original_email_id", "partition", "received_at"
    )


@query
def attribute_clicks(spark, sf):
    return correlation.attribute_clicks(v.clicks(spark, sf), v.emails(spark, sf))


@query
def click_stats(spark, sf):
    return correlation.click_stats(v.clicks(spark, sf))


@query
def orphans(spark, sf):
    return correlation.orphans(_webhook_events(spark, sf), v.webhooks(spark, sf), "webhook_id").select(
        "id", "webhook_id", "received_at"
    )


@query
def orphan_emails(spark, sf):
    running = v.campaigns(spark, sf).filter("status <> 'draft'")
    return correlation.orphans(v.emails(spark, sf), running, "campaign_id").select("id", "campaign_id")


@query
def orphan_sweep(spark, sf):
    """What is left without a parent once campaigns in draft, some leads and webhooks and failing agents are deleted."""
    mails = v.emails(spark, sf)
    return correlation.orphan_sweep({
        "campaigns": v.campaigns(spark, sf).filter("status <> 'draft'"),
        "leads": v.leads(spark, sf).filter("CAST(id AS BIGINT) % 10 <> 7"),
        "emails": mails,
        "replies": correlation.correlate_replies(v.replies(spark, sf), mails),
        "clicks": v.clicks(spark, sf),
        "webhooks": v.webhooks(spark, sf),
        "webhook_events": v.raw_webhook_calls(v.table(spark, sf, "events")),
        "agents": v.agents(spark, sf).filter("status <> 'error'"),
        "agent_keys": v.agents(spark, sf).select(F.concat(F.lit("key-"), F.col("id")).alias("id"), F.col("id").alias("agent_id")),
    })


@query
def dedupe_deliveries(spark, sf):
    events = _webhook_events(spark, sf).withColumn("event_id", F.col("event.event_id"))
    return correlation.dedupe_deliveries(events.select("id", "event_id", "received_at"))


# --- status ----------------------------------------------------------------------------------------

@query
def fold_email_status(spark, sf):
    return lifecycle.fold_email_status(v.lifecycle(v.table(spark, sf, "events")))


@query
def applied_events(spark, sf):
    return lifecycle.applied_events(v.lifecycle(v.table(spark, sf, "events")))


@query
def status_times(spark, sf):
    return lifecycle.status_times(v.lifecycle(v.table(spark, sf, "events")))


@query
def event_counters(spark, sf):
    events = v.lifecycle_with_campaign(v.table(spark, sf, "events"))
    return lifecycle.event_counters(lifecycle.mark_applied(events))


def _match_calls(calls: DataFrame, webhooks: DataFrame, mails: DataFrame) -> DataFrame:
    """Stored webhook calls to the provider's lifecycle events of e-mails."""
    routed = correlation.route_events(calls, webhooks)
    provider = correlation.classify_event(correlation.extract_message_ids(routed))
    return correlation.correlate_events(provider.select("id", "message_id", "thread_id", "status", "received_at"), mails)


def _match_replies(calls: DataFrame, webhooks: DataFrame, mails: DataFrame) -> DataFrame:
    """Stored webhook calls to inbound replies with their e-mails."""
    return correlation.correlate_replies(correlation.extract_replies(correlation.route_events(calls, webhooks)), mails)


@query
def extract_replies(spark, sf):
    return _match_replies(_webhook_events(spark, sf), v.webhooks(spark, sf), v.emails(spark, sf)).select(
        "id", "campaign_id", "lead_id", "original_email_id", "agentmail_thread_id", "agentmail_message_id",
        "from", "subject", "text", "received_at", "arrived_at",
    )


def _matched_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event log from raw webhook calls, clicks and replies."""
    calls, hooks, mails = _webhook_events(spark, sf), v.webhooks(spark, sf), v.emails(spark, sf)
    called = _match_replies(calls, hooks, mails)
    kept = correlation.correlate_replies(v.replies(spark, sf), mails)
    return lifecycle.lifecycle_events(
        _match_calls(calls, hooks, mails),
        called.unionByName(kept, allowMissingColumns=True).withColumn(
            "arrived_at", F.coalesce("arrived_at", "received_at")
        ),
        correlation.attribute_clicks(v.clicks(spark, sf), mails),
    )


@query
def event_counters_from_calls(spark, sf):
    """Campaign counters from all that was received, on top of the stored e-mails."""
    before = v.emails(spark, sf).select(F.col("id").alias("email_id"), lifecycle.status_rank(F.col("status")).alias("rank"))
    log = stored(_matched_log(spark, sf), "event-log")
    counters = lifecycle.event_counters(lifecycle.mark_applied(log, entered=before))
    return lifecycle.count_logged_clicks(counters, v.clicks(spark, sf))


@query
def lifecycle_events(spark, sf):
    return _matched_log(spark, sf).drop("stamp")


@query
def emails_with_status(spark, sf):
    """E-mails after all that was received about them."""
    return lifecycle.with_status(v.emails(spark, sf), stored(_matched_log(spark, sf), "event-log")).select(
        "id", "status", "click_count", "last_clicked_at", "sent_at", "delivered_at", "bounced_at", "complained_at",
        "failed_at", "replied_at",
    )


# --- funnel ----------------------------------------------------------------------------------------

@query
def campaign_summary(spark, sf):
    return funnel.campaign_summary(v.campaigns(spark, sf), v.emails_with_clicks(spark, sf))


@query
def outreach_totals(spark, sf):
    return funnel.outreach_totals(v.campaigns(spark, sf), v.emails_with_clicks(spark, sf))


@query
def funnel_rates(spark, sf):
    counters = funnel.email_counters(v.emails_with_clicks(spark, sf))
    return funnel.funnel_rates(counters)


@query
def campaign_counters(spark, sf):
    return funnel.campaign_counters(v.leads(spark, sf), v.emails_with_clicks(spark, sf))


@query
def step_stats(spark, sf):
    return funnel.step_stats(v.emails_with_clicks(spark, sf))


@query
def step_gate(spark, sf):
    return funnel.step_gate(funnel.step_stats(v.emails(spark, sf))).select(
        "campaign_id", "step", "drafted", "sent", "sendable"
    )


@query
def counter_drift(spark, sf):
    return funnel.counter_drift(v.campaigns(spark, sf), v.emails(spark, sf))


@query
def flywheel_totals(spark, sf):
    return funnel.flywheel_totals(v.counted_campaigns(spark, sf))


@query
def campaign_card(spark, sf):
    return funnel.campaign_card(v.counted_campaigns(spark, sf))


# --- sequences -------------------------------------------------------------------------------------

@query
def plan_sequence(spark, sf):
    return sequence.plan_sequence(v.leads(spark, sf), v.emails(spark, sf))


@query
def plan_summary(spark, sf):
    return sequence.plan_summary(v.leads(spark, sf), v.emails(spark, sf))


@query
def draft_work_order(spark, sf):
    return sequence.draft_work_order(sequence.plan_sequence(v.leads(spark, sf), v.emails(spark, sf)))


@query
def draft_context(spark, sf):
    people, mails = v.leads(spark, sf), v.emails(spark, sf)
    plan = sequence.plan_sequence(people, mails)
    sender = {"name": "Ann", "offer": "a site audit"}
    return sequence.draft_context(plan, people, v.campaigns(spark, sf), mails, sender=sender)


@query
def draft_context_one_off(spark, sf):
    people, mails = v.leads(spark, sf), v.emails(spark, sf)
    plan = sequence.plan_sequence(people, mails)
    return sequence.draft_context(plan, people, v.campaigns(spark, sf), mails, framework="one-off")


@query
def dedupe_new_drafts(spark, sf):
    """Drafted e-mails as new ones beside the rest."""
    mails = v.emails(spark, sf)
    is_new = F.coalesce(F.col("status") == "drafted", F.lit(False))
    return sequence.dedupe_new_drafts(mails.filter(is_new), mails.filter(~is_new)).select("id", "skipped")


@query
def select_sendable(spark, sf):
    return sequence.select_sendable(v.emails(spark, sf), step=2).select("id", "campaign_id", "lead_id")


@query
def select_sendable_by_ids(spark, sf):
    wanted = v.table(spark, sf, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS id")
    return sequence.select_sendable(v.emails(spark, sf), ids=wanted).select("id", "campaign_id", "lead_id")


@query
def outbound_messages(spark, sf):
    sendable = sequence.select_sendable(v.emails(spark, sf))
    return sequence.outbound_messages(sendable, v.BASE_URL).select("id", "to_email", "subject", "html")


@query
def default_bodies(spark, sf):
    return sequence.default_bodies(v.emails(spark, sf)).select("id", "body_html")


@query
def normalize_drafts(spark, sf):
    return sequence.normalize_drafts(v.model_answers(spark, sf))


@query
def send_report(spark, sf):
    return sequence.send_report(v.send_results(spark, sf))


@query
def send_report_of_runs(spark, sf):
    """The report for all campaigns that were run, those with nothing to send too."""
    runs = v.campaigns(spark, sf).select(F.col("id").alias("campaign_id"))
    return sequence.send_report(v.send_results(spark, sf), runs)


@query
def normalize_steps(spark, sf):
    """Steps of drafts as a model and as an agent asks for them."""
    asked = v.drafts(spark, sf)
    model = sequence.normalize_step(asked).withColumn("by", F.lit("model"))
    return model.unionByName(sequence.normalize_created_step(asked).withColumn("by", F.lit("agent")))


@query
def outbound_headers(spark, sf):
    """Names and addresses of outgoing mail, and its text as HTML."""
    name = F.when(F.col("id").cast("bigint") % 2 == 0, F.concat(F.lit(' "'), F.col("to_name"), F.lit('"\r\n')))
    return v.emails(spark, sf).select(
        "id", text.sanitize_display_name(text.default_name(name, F.col("to_email"))).alias("to_name"),
        text.local_part(F.col("to_email")).alias("mailbox"), html.html_escape(F.col("body_html")).alias("escaped"),
    )


@query
def map_run_status(spark, sf):
    return sequence.map_run_status(v.runs(spark, sf))


# --- lists, feed -----------------------------------------------------------------------------------

@query
def newest_first(spark, sf):
    rows = ordering.newest_first(v.emails(spark, sf), "created_at", ordering.LIST_LIMITS["emails"])
    return rows.select("id", "campaign_id", "created_at")


@query
def newest_per_group(spark, sf):
    rows = ordering.newest_per_group(v.emails(spark, sf), "campaign_id", 5, "created_at")
    return rows.select("id", "campaign_id", "created_at")


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    events = v.table(spark, sf, "events")
    campaigns = v.campaigns(spark, sf)
    matched = correlation.correlate_replies(v.replies(spark, sf), v.emails(spark, sf))
    created = v.emails(spark, sf)
    return feed.activity_feed(
        feed.from_log(v.activity(spark, sf)),
        feed.from_webhook_events(v.raw_webhook_calls(events), v.webhooks(spark, sf)),
        feed.from_replies(matched),
        feed.from_clicks(v.clicks(spark, sf), campaigns),
        feed.from_submissions(_submissions(spark, sf)),
        feed.from_new_tasks(v.tasks(spark, sf)),
        feed.from_new_agents(v.agents(spark, sf)),
        feed.from_invitations(v.invitations(spark, sf)),
        feed.from_new_pages(v.pages(spark, sf)),
        feed.from_new_campaigns(campaigns),
        feed.from_test_leads(v.leads(spark, sf), campaigns),
        feed.from_agent_drafts(created),
    )


@query
def activity_feed(spark, sf):
    return _feed(spark, sf)


@query
def activity_feed_changes(spark, sf):
    """The feed's other nine sources."""
    changed = v.changed_things(spark, sf)
    return feed.activity_feed(*[getattr(feed, f"from_{kind}")(rows) for kind, rows in changed.items()])


@query
def new_entries(spark, sf):
    """The newest entry, if it is none of those that were remembered a day before it."""
    log = feed.from_log(v.activity(spark, sf))
    newest = log.agg(F.max("created_at")).scalar()
    before = log.filter(F.col("created_at") < newest - F.expr("INTERVAL 1 DAY"))
    return feed.flag_new_entries(log, feed.remembered_ids(before))


@query
def feed_active(spark, sf):
    return feed.feed_active(feed.from_log(v.activity(spark, sf)), F.lit("2024-01-05 00:00:00").cast("timestamp"))


@query
def dedupe_feed(spark, sf):
    """The live list over the feed with every logged row in it twice."""
    logged = feed.from_log(v.activity(spark, sf))
    return feed.dedupe_feed(feed.activity_feed(logged, logged))


@query
def route_activity(spark, sf):
    rows = feed.route_activity(v.activity(spark, sf))
    return rows.select("id", "route", feed.category_or_default(F.col("category")).alias("shown_as"))


@query
def activity_with_agent(spark, sf):
    return feed.activity_with_agent(v.activity(spark, sf), v.agents(spark, sf)).select("id", "agent_id", "emoji")


# --- boards, forms, pages --------------------------------------------------------------------------

@query
def kanban_counts(spark, sf):
    return boards.kanban_counts(v.tasks(spark, sf))


@query
def office_stats(spark, sf):
    return boards.office_stats(v.agents(spark, sf), v.tasks(spark, sf), v.activity(spark, sf))


@query
def replies_to_tasks(spark, sf):
    matched = correlation.correlate_replies(v.replies(spark, sf), v.emails(spark, sf))
    return boards.replies_to_tasks(matched)


@query
def webhook_counts(spark, sf):
    return boards.webhook_counts(v.webhooks(spark, sf), v.raw_webhook_calls(v.table(spark, sf, "events")))


@query
def inbox(spark, sf):
    matched = correlation.correlate_replies(v.replies(spark, sf), v.emails(spark, sf))
    return boards.reply_preview(matched)


@query
def tabulate_form(spark, sf):
    """Submissions of one form as a wide table."""
    return boards.tabulate_form(_submissions(spark, sf), "form-3", [("k", "Key"), ("e_mail", "E-Mail")])


@query
def agent_directory(spark, sf):
    """Agents as they are shown: sign-in name, last sign of life, masked key."""
    now, key = F.lit("2024-01-02 05:00:00").cast("timestamp"), F.concat(F.lit("key-"), F.col("name"))
    return v.agents(spark, sf).select(
        "id", text.sign_in_name(F.col("name"), F.lit(None).cast("string"), F.col("id")).alias("sign_in_name"),
        text.time_ago(F.col("last_heartbeat"), now).alias("seen"), text.mask_secret(key).alias("secret"),
        text.mask_secret(F.col("id")).alias("short_secret"), text.mask_all_but_last4(key).alias("listed"),
    )


@query
def publish_pages(spark, sf):
    """Crawled pages under the slugs made of their addresses."""
    named = v.table(spark, sf, "pages").select("page_id", F.col("url").alias("slug"))
    return pages.normalize_page_slugs(named)


@query
def event_properties(spark, sf):
    return v.table(spark, sf, "events").select("event_id", text.json_path(F.col("props"), "$.k").alias("k"))


@query
def submission_counts(spark, sf):
    return boards.submission_counts(v.forms(spark, sf), _submissions(spark, sf))


@query
def normalize_form_fields(spark, sf):
    fields = boards.normalize_form_fields(v.forms(spark, sf))
    return fields.select("slug", F.posexplode("fields").alias("position", "f")).select("slug", "position", "f.*")


@query
def tabulate_submissions(spark, sf):
    return boards.tabulate_submissions(boards.normalize_form_fields(v.forms(spark, sf)), _submissions(spark, sf))


@query
def classify_pages(spark, sf):
    return pages.classify_pages(v.pages(spark, sf)).select("slug", "full_html")


@query
def link_pages_forms(spark, sf):
    return pages.link_pages_forms(v.pages(spark, sf), v.forms(spark, sf))


@query
def resolve_page_form(spark, sf):
    return pages.resolve_page_form(v.pages(spark, sf), v.forms(spark, sf))


@query
def rewrite_links(spark, sf):
    from heliograph.functions.html import rewrite_links as rewrite

    html = rewrite(F.col("html"), v.BASE_URL, F.lit("c1"), F.lit("l1"), F.col("page_id"))
    return v.table(spark, sf, "pages").select("page_id", html.alias("html"))


# --- snapshots, sessions ---------------------------------------------------------------------------

@query
def latest_snapshot(spark, sf):
    return snapshots.latest_snapshot(v.changes(spark, sf), ["id"], ["title", "priority"], ["at", "seq"])


@query
def merged_snapshot(spark, sf):
    """The snapshot of the older changes, kept by hash bucket, and the later ones merged into it."""
    log, fields, order = v.changes(spark, sf), ["title", "priority"], ["at", "seq"]
    states, update = jobs.snapshot_keeper(spark, scratch_path(spark, "snapshot"), log, "id", fields, order)
    later = F.col("at") >= F.lit("1995-06-01").cast("timestamp")
    update(log.filter(~later), 0)
    update(log.filter(later), 1)
    return snapshots.snapshot_of(states.read(), ["id"], fields, order)


@query
def activity_feed_from_changes(spark, sf):
    """Moved tasks, updated pages and deleted agents, from the change logs of tasks, pages and agents."""
    return feed.activity_feed(
        feed.from_task_moves(snapshots.task_moves(v.task_changes(spark, sf))),
        feed.from_page_updates(snapshots.page_updates(v.page_changes(spark, sf), ["title", "theme"])),
        feed.from_deleted_agents(snapshots.deletions(v.changes(spark, sf))),
    )


@query
def agent_presence(spark, sf):
    beats = v.table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS agent_id", "CAST(ts AS TIMESTAMP) AS at")
    return snapshots.agent_presence(v.agents(spark, sf), beats)


@query
def fold_transcript(spark, sf):
    return sessions.fold_transcript(v.transcript_chunks(spark, sf), block=4)


@query
def merge_tool_calls(spark, sf):
    return sessions.merge_tool_calls(v.tool_calls(spark, sf))


@query
def session_summary(spark, sf):
    lines = sessions.fold_transcript(v.transcript_chunks(spark, sf))
    return sessions.session_summary_from_turns(
        v.sessions(spark, sf), lines, sessions.merge_tool_calls(v.tool_calls(spark, sf))
    )


@query
def session_invitations(spark, sf):
    return sessions.session_invitations(v.sessions(spark, sf), v.invitations(spark, sf))


@query
def pending_invitations(spark, sf):
    return sessions.pending_invitations(v.invitations(spark, sf))


# --- streams ---------------------------------------------------------------------------------------

def _latest(*keys: str):
    return lambda rows: sinks.latest_per_key(rows, keys)


@query
def stream_email_status(spark, sf):
    status = jobs.stream_email_status(v.lifecycle(v.stream(spark, sf, "events", STREAM_BATCH_BYTES)))
    return sinks.run_available(spark, status, "update", merge=_latest("email_id"))


@query
def stream_status_from_calls(spark, sf):
    """E-mails as a stream into the look-up by their ids, then raw webhook calls as a stream to the status of
    the e-mails they are about; clicks are not part of the calls."""
    index = jobs.EmailIndex(spark, scratch_path(spark, "emails"))
    sinks.run_updates(v.emails(spark, sf, v.stream(spark, sf, "orders", STREAM_BATCH_BYTES)), index.add)
    hooks = v.webhooks(spark, sf)
    states, update = jobs.status_keeper(spark, scratch_path(spark, "status"), lambda calls: jobs.status_of_calls(calls, hooks, index))
    sinks.run_updates(ingest.parse_webhook_events(v.raw_webhook_calls(v.stream(spark, sf, "events", STREAM_BATCH_BYTES))), update)
    return lifecycle.status_of(states.read()).select("email_id", "status", "events")


@query
def stream_applied_events(spark, sf):
    events = v.lifecycle_with_campaign(v.stream(spark, sf, "events", STREAM_BATCH_BYTES))
    marked = sinks.run_available(spark, events, transform=jobs.arrival_order_marker(spark, scratch_path(spark, "ranks")))
    return marked.filter("applied").drop("applied", "batch_id", "campaign_id")


@query
def stream_campaign_counters(spark, sf):
    events = v.lifecycle_with_campaign(v.stream(spark, sf, "events", STREAM_BATCH_BYTES))
    increments = jobs.marked_increments(spark, scratch_path(spark, "ranks"))
    return sinks.run_available(spark, events, transform=increments, merge=lambda rows: sinks.summed_per_key(rows, ["campaign_id"]))


@query
def stream_activity_feed(spark, sf):
    events = v.stream(spark, sf, "events", STREAM_BATCH_BYTES)
    tokens = v.click_tokens(v.stream(spark, sf, "lineitem", STREAM_BATCH_BYTES))
    clicks = ingest.decode_click_tokens(tokens).filter("logged")
    entries = jobs.stream_activity_feed(
        feed.from_webhook_events(v.raw_webhook_calls(events), v.webhooks(spark, sf)),
        feed.from_clicks(clicks, v.campaigns(spark, sf)),
    )
    return sinks.run_available(spark, entries).drop("batch_id")


@query
def stream_whole_feed(spark, sf):
    """Twelve sources of the feed as streams; replies find their e-mails in the look-up that the stream of e-mails keeps."""
    def rows(name):
        return v.stream(spark, sf, name, STREAM_BATCH_BYTES)

    index = jobs.EmailIndex(spark, scratch_path(spark, "emails"))
    sinks.run_updates(v.emails(spark, sf, rows("orders")), index.add)
    answers = v.replies(spark, sf, rows("conversations"))
    replied = sinks.run_available(spark, answers, transform=lambda batch, _: feed.from_replies(index.match_replies(batch)))
    events, campaigns = rows("events"), v.campaigns(spark, sf)
    entries = jobs.stream_activity_feed(
        feed.from_log(v.activity(spark, sf, events)),
        feed.from_webhook_events(v.raw_webhook_calls(events), v.webhooks(spark, sf)),
        feed.from_clicks(v.clicks(spark, sf, rows("lineitem")), campaigns),
        feed.from_submissions(ingest.parse_submissions(v.raw_submissions(events), v.forms(spark, sf))),
        feed.from_new_tasks(v.tasks(spark, sf, rows("orders"))),
        feed.from_new_agents(v.agents(spark, sf, rows("supplier"))),
        feed.from_invitations(v.invitations(spark, sf, rows("supplier"))),
        feed.from_new_pages(v.pages(spark, sf, rows("pages"))),
        feed.from_new_campaigns(v.campaigns(spark, sf, rows("nation"))),
        feed.from_test_leads(v.leads(spark, sf, rows("customer")), campaigns),
        feed.from_agent_drafts(v.emails(spark, sf, rows("orders"))),
    )
    return sinks.run_available(spark, entries).unionByName(replied).drop("batch_id")


@query
def stream_clicks(spark, sf):
    clicks = jobs.stream_clicks(v.click_tokens(v.stream(spark, sf, "lineitem", STREAM_BATCH_BYTES)))
    return sinks.run_available(spark, clicks, transform=jobs.click_increments, merge=jobs.merge_click_stats, reused=False)


@query
def webhook_health(spark, sf):
    """Calls and probes as streams; either may come first."""
    source = v.stream(spark, sf, "events", STREAM_BATCH_BYTES)
    calls = v.raw_webhook_calls(source).select(F.lit("call").alias("kind"), "webhook_id", F.col("received_at").alias("at"), F.lit(None).cast("string").alias("probe_id"))
    probes = v.probes(spark, sf, source).select(F.lit("probe").alias("kind"), "webhook_id", F.col("since").alias("at"), "probe_id")
    counter = jobs.ArrivalCounter(spark, scratch_path(spark, "probes"), span_seconds=7 * 86_400)
    arrived = sinks.run_available(spark, calls.unionByName(probes), transform=counter, merge=lambda rows: sinks.summed_per_key(rows, ["probe_id"]))
    return jobs.webhook_health(v.probes(spark, sf), arrived)


@query
def stream_live_feed(spark, sf):
    """The live list over the streams that the feed has, with the entry that flashes and whether the feed is active."""
    events = v.stream(spark, sf, "events", STREAM_BATCH_BYTES)
    tokens = v.click_tokens(v.stream(spark, sf, "lineitem", STREAM_BATCH_BYTES))
    entries = jobs.stream_activity_feed(
        feed.from_log(v.activity(spark, sf, events)),
        feed.from_webhook_events(v.raw_webhook_calls(events), v.webhooks(spark, sf)),
        feed.from_clicks(ingest.decode_click_tokens(tokens).filter("logged"), v.campaigns(spark, sf)),
        feed.from_submissions(ingest.parse_submissions(v.raw_submissions(events), v.forms(spark, sf))),
    )
    live = sinks.run_available(spark, entries, transform=jobs.LiveFeed(spark, scratch_path(spark, "live")), merge=sinks.last_batch)
    active = feed.feed_active(live, F.lit("2024-01-05 00:00:00").cast("timestamp")).select("active").scalar()
    first = F.col("position") == 1
    return live.select(*feed.FEED_COLUMNS, "position", F.when(first, F.col("flashed")).alias("flashed"), F.when(first, active).alias("active"))


@query
def stream_dedupe_deliveries(spark, sf):
    calls = ingest.parse_webhook_events(v.raw_webhook_calls(v.stream(spark, sf, "events", STREAM_BATCH_BYTES)))
    events = calls.withColumn("event_id", F.col("event.event_id")).select("id", "event_id", "received_at")
    kept = sinks.run_available(spark, events, transform=jobs.redelivery_filter(spark, scratch_path(spark, "seen")))
    # Which delivery of an event comes in first is up to the files; that there is one is not.
    return kept.select("event_id", F.when(F.col("event_id").isNull(), F.col("id")).alias("id"))
