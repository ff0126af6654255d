"""Planning, drafting and sending of e-mail sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.html import default_body_html, outbound_html, rewrite_links
from heliograph.functions.json import parse_strict, parsed_field, parsed_is_null, parsed_ok
from heliograph.functions.keys import lookup_key, spread_key
from heliograph.functions.text import js_trim, strip_code_fences, truthy
from heliograph.operators.leads import contactable_leads, has_email

# The sequence frameworks and the default subject.
FRAMEWORKS = ("pas", "aida", "sdr")
ONE_OFF = "one-off"
DEFAULT_SUBJECT = "Quick question"


def step_of(c: str = "sequence_position") -> Column:
    """Old drafts carry no step and count as the first."""
    return F.coalesce(F.col(c), F.lit(1))


def normalize_step(drafts: DataFrame) -> DataFrame:
    """Requested framework, step and total of a model-written draft brought into range."""
    fw = F.when(F.col("framework").isin(*FRAMEWORKS), F.col("framework")).otherwise(ONE_OFF)

    def in_range(c: str) -> Column:
        return F.when(F.col(c).between(1, 5), F.floor(c).cast("int"))

    return drafts.select(
        *[c for c in drafts.columns if c not in ("framework", "step", "total_steps")],
        fw.alias("framework"),
        F.coalesce(in_range("step"), F.lit(1)).alias("step"),
        F.coalesce(in_range("total_steps"), F.when(fw == ONE_OFF, 1).otherwise(3)).alias("total_steps"),
    )


def normalize_created_step(drafts: DataFrame) -> DataFrame:
    """The same for agent-written drafts: no upper bound, and the total defaults to the step."""
    fw = F.when(F.col("framework").isin(*FRAMEWORKS, ONE_OFF), F.col("framework")).otherwise(ONE_OFF)

    def at_least_one(c: str) -> Column:
        return F.when(F.col(c) >= 1, F.floor(c).cast("int"))

    step = F.coalesce(at_least_one("step"), F.lit(1))
    return drafts.select(
        *[c for c in drafts.columns if c not in ("framework", "step", "total_steps")],
        fw.alias("framework"),
        step.alias("step"),
        F.coalesce(at_least_one("total_steps"), step).alias("total_steps"),
    )


def normalize_drafts(answers: DataFrame, text: str = "text") -> DataFrame:
    """Model answers to drafts. `ok` is false, and the fields are null, where the answer is no JSON.

    Code fences go first: an answer that parses as it is has none, so nothing is lost and each text
    is parsed once.
    """
    p, ok = F.col("_p"), F.col("ok")

    def field(name: str) -> Column:
        return js_trim(F.coalesce(F.col(f"_{name}"), F.lit("")))

    fields = ("subject", "body_text", "body_html")
    subject = F.when(field("subject") != "", field("subject")).otherwise(DEFAULT_SUBJECT)
    carried = [c for c in answers.columns if c != text]
    return (
        answers.select(*carried, parse_strict(strip_code_fences(F.col(text))).alias("_p"))
        .select(
            *carried, (parsed_ok(p) & ~parsed_is_null(p)).alias("ok"),
            *[parsed_field(p, name).alias(f"_{name}") for name in fields],
        )
        .select(
            *carried,
            "ok",
            F.when(ok, subject).alias("subject"),
            F.when(ok, field("body_text")).alias("body_text"),
            F.when(ok, field("body_html")).alias("body_html"),
        )
    )


def existing_pairs(emails: DataFrame) -> DataFrame:
    """Distinct (lead, step) pairs that have an e-mail. Combines before the shuffle, so a lead with
    very many e-mails is one row per step afterwards."""
    return (
        emails.filter(F.col("lead_id").isNotNull())
        .select("campaign_id", "lead_id", step_of().alias("step"))
        .distinct()
    )


def plan_sequence(leads: DataFrame, emails: DataFrame, steps: int = 3) -> DataFrame:
    """Contactable leads times steps 1..N, less the pairs that have an e-mail."""
    wanted = contactable_leads(leads).select(
        "campaign_id",
        F.col("id").alias("lead_id"),
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"),
    )
    return wanted.join(existing_pairs(emails), ["campaign_id", "lead_id", "step"], "left_anti")


def plan_summary(leads: DataFrame, emails: DataFrame, steps: int = 3) -> DataFrame:
    """Per campaign: pairs to draft, pairs skipped because they exist, and leads without address."""
    missing = ~has_email()
    totals = leads.groupBy("campaign_id").agg(
        F.count_if(has_email()).alias("contactable"),
        F.count_if(missing).alias("skipped_no_email"),
        F.count_if(missing & truthy(F.col("website"))).alias("skipped_with_website"),
    )
    planned = plan_sequence(leads, emails, steps).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return totals.join(planned, "campaign_id", "left").select(
        "campaign_id",
        n.alias("planned"),
        (F.col("contactable") * steps - n).alias("skipped_already_drafted"),
        "skipped_no_email",
        "skipped_with_website",
    )


def draft_work_order(plan: DataFrame) -> DataFrame:
    """All first steps, then all second steps, and so on; by lead inside a step."""
    return plan.orderBy("step", "lead_id", "campaign_id")


def _labelled(label: str, c: Column) -> Column:
    return F.when(truthy(c), F.concat(F.lit(f"{label}: "), c))


# Fixed value: the heading of the earlier steps.
PREVIOUS_STEPS = "PREVIOUS STEPS (for continuity — reference implicitly, never copy):"


def draft_context(
    plan: DataFrame,
    leads: DataFrame,
    campaigns: DataFrame,
    emails: DataFrame,
    framework: str = "pas",
    total_steps: int = 3,
    sender: dict[str, str] | None = None,
) -> DataFrame:
    """What the model is told for each planned (lead, step), as ordered parts.

    Part `context` has the recipient, the sender and the sequence header; if the lead has earlier steps,
    part `heading` and parts `previous` follow, by (`part_step`, `part_at`, `part_id`). A prompt is its
    parts in this order, joined by blank lines, the heading and what follows by a line end. The parts
    stay rows: a lead may have any number of e-mails (batch drafting repeats first steps), and rows are
    never gathered into one value.
    """
    # The labels and headings of the prompt.
    sender = sender or {}
    recipient = F.concat_ws(
        "\n",
        _labelled("Business", F.col("name")),
        F.when(F.col("company") != F.coalesce("name", F.lit("")), _labelled("Company", F.col("company"))),
        _labelled("Category", F.col("category")),
        _labelled("Location", F.col("address")),
        _labelled("Website", F.col("website")),
        _labelled("Notes", F.col("notes")),
    )
    sender_block = F.concat_ws(
        "\n",
        _labelled("Sender name", F.lit(sender.get("name"))),
        _labelled("Sender company", F.lit(sender.get("company"))),
        _labelled("Offer / value", F.lit(sender.get("offer"))),
        _labelled("ICP context", F.col("query")),
    )
    header = F.lit("")
    if framework != ONE_OFF:
        header = F.concat(
            F.lit(f"\n\nFRAMEWORK: {framework}\nSTEP: "), F.col("step").cast("string"),
            F.lit(f" of {total_steps}"),
        )
    people = contactable_leads(leads).withColumnRenamed("id", "lead_id")
    queries = campaigns.select(F.col("id").alias("campaign_id"), "query")
    context = (
        plan.join(people, ["campaign_id", "lead_id"])
        .join(queries, "campaign_id")
        .select(
            "campaign_id", "lead_id", "step",
            F.lit("context").alias("part"),
            F.lit(0).alias("part_step"),
            F.lit(None).cast("timestamp").alias("part_at"),
            F.lit(None).cast("string").alias("part_id"),
            F.concat(
                F.lit("RECIPIENT\n"), F.coalesce(F.nullif(recipient, F.lit("")), F.lit("(no data)")),
                F.lit("\n\nSENDER\n"), F.coalesce(F.nullif(sender_block, F.lit("")), F.lit("(no context)")),
                header,
            ).alias("text"),
        )
    )
    if framework == ONE_OFF:
        return context
    earlier = emails.select(
        "campaign_id", "lead_id",
        step_of().alias("part_step"),
        F.col("created_at").alias("part_at"),
        F.col("id").alias("part_id"),
        F.concat(
            F.lit("--- STEP "), step_of().cast("string"), F.lit(" ---\nSubject: "),
            F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body_text", F.lit("")),
        ).alias("text"),
    )
    # One row per planned step of a lead and at most `total_steps` of these, so the join makes at
    # most that many rows per earlier e-mail, and the e-mail side may be split when skewed.
    previous = (
        earlier.join(plan, ["campaign_id", "lead_id"])
        .filter("part_step < step")
        .withColumn("part", F.lit("previous"))
    )
    first = earlier.groupBy("campaign_id", "lead_id").agg(F.min("part_step").alias("_first"))
    heading = first.join(plan, ["campaign_id", "lead_id"]).filter("_first < step").select(
        "campaign_id", "lead_id", "step", F.lit("heading").alias("part"), F.lit(0).alias("part_step"),
        F.lit(None).cast("timestamp").alias("part_at"), F.lit("").alias("part_id"), F.lit(PREVIOUS_STEPS).alias("text"),
    )
    return context.unionByName(heading).unionByName(previous.select(context.columns))


def dedupe_new_drafts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New drafts with `skipped`: true where the (lead, step) pair already had an e-mail, or where an
    earlier new draft took it. A draft without lead is nobody's second and is not skipped."""
    keyed = new.withColumn("_step", step_of())
    keys = ["campaign_id", "lead_id", "_step"]
    first = keyed.groupBy(*keys).agg(F.min(F.struct("created_at", "id")).alias("_first"))
    taken = existing_pairs(existing).withColumnRenamed("step", "_step").withColumn("_taken", F.lit(True))
    pair = [F.col(k) for k in keys]
    winners = first.join(taken, keys, "left").select(
        lookup_key(*pair).alias("_pair"), F.when(F.col("_taken").isNull(), F.col("_first.id")).alias("_winner")
    )
    return keyed.withColumn("_pair", spread_key(F.col("id"), *pair)).join(winners, "_pair", "left").select(
        *new.columns, (truthy(F.col("lead_id")) & ~F.coalesce(F.col("id") == F.col("_winner"), F.lit(False))).alias("skipped")
    )


def default_bodies(emails: DataFrame) -> DataFrame:
    """Drafts without HTML get it from their text."""
    return emails.withColumn("body_html", default_body_html(F.col("body_html"), F.col("body_text")))


def select_sendable(emails: DataFrame, ids: DataFrame | None = None, step: float | None = None) -> DataFrame:
    """Drafted e-mails to send now.

    A table of `id`s wins over everything. A step takes the drafts of that step, and beyond the
    first leaves out leads that have replied to any e-mail. Neither takes all drafts.
    """
    step = math.floor(step) if step is not None and step >= 1 else None
    drafted = emails.filter(F.col("status") == "drafted")
    if ids is not None:
        return drafted.join(ids.select("id").distinct(), "id", "left_semi")
    if step is None:
        return drafted
    at_step = drafted.filter(step_of() == step)
    if step == 1:
        return at_step
    lead = (F.col("campaign_id"), F.col("lead_id"))
    replied = (
        emails.filter(F.col("status") == "replied")
        .select("campaign_id", "lead_id").distinct()
        .select(lookup_key(*lead).alias("_lead"))
    )
    return at_step.withColumn("_lead", spread_key(F.col("id"), *lead)).join(replied, "_lead", "left_anti").drop("_lead")


def outbound_messages(emails: DataFrame, base_url: str) -> DataFrame:
    """Sendable e-mails with their links routed through the click tracker."""
    body = outbound_html(F.col("body_html"), F.col("body_text"))
    return emails.withColumn(
        "html",
        rewrite_links(body, base_url, F.col("campaign_id"), F.col("lead_id"), F.col("id")),
    )


def send_report(results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per campaign: sent, total, errors and the campaign's status after the run.

    `runs` names the campaigns that were run, so that one with nothing to send is reported as failed.
    """
    report = results.groupBy("campaign_id").agg(
        F.count_if("ok").alias("sent"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("ok")).alias("errors"),
    )
    if runs is not None:
        report = runs.select("campaign_id").join(report, "campaign_id", "left").fillna(0)
    return report.withColumn("status", F.when(F.col("sent") > 0, "completed").otherwise("failed"))


def map_run_status(runs: DataFrame) -> DataFrame:
    """State of a campaign after polling its scrape run.

    Only a searching campaign with a run moves; the others keep their status.
    """
    dataset = F.coalesce("run_dataset_id", "campaign_dataset_id")
    live = (F.col("status") == "searching") & truthy(F.col("run_id"))
    done = F.col("run_status") == "SUCCEEDED"
    broken = F.col("run_status").isin("FAILED", "ABORTED", "TIMED-OUT")
    no_data = done & ~truthy(dataset)
    after = (
        F.when(~live, F.col("status")).when(no_data | broken, "failed").when(done, "ready").otherwise("searching")
    )
    # The stored error texts.
    error = (
        F.when(live & no_data, "Apify succeeded but no dataset id was returned")
        .when(
            live & broken,
            F.concat(
                F.lit("Apify run "), F.lower("run_status"), F.lit(": "),
                F.coalesce("run_message", F.lit("no details")),
            ),
        )
    )
    return runs.select(
        "campaign_id",
        "run_id",
        after.alias("status"),
        error.alias("error_message"),
        F.coalesce(live & (done | broken), F.lit(False)).alias("changed"),
    )
