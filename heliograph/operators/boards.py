"""Tasks, agents, webhooks, forms and submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.text import field_slug, map_get

# The columns of the task board, and the types a form field may have.
BOARD_COLUMNS = ("todo", "doing", "needs_input", "canceled", "done")
FIELD_TYPES = ("text", "email", "textarea", "tel", "url", "number", "date")
OFFICE_FEED_ROWS = 20


def kanban_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per board column; all five are always there, other statuses are not.

    One aggregation to a single row, unfolded into the columns.
    """
    counts = tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in BOARD_COLUMNS])
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(s).alias("status"), F.col(s).alias("tasks"))
            for i, s in enumerate(BOARD_COLUMNS)
        ]
    )
    return counts.select(F.inline(columns))


def office_stats(agents: DataFrame, tasks: DataFrame, activity: DataFrame) -> DataFrame:
    """Agents online, tasks in work and activity rows shown. The last is a list length, not a total."""
    online = agents.agg(F.count_if(F.col("status") == "online").alias("active_agents"))
    doing = tasks.agg(F.count_if(F.col("status") == "doing").alias("tasks_in_progress"))
    shown = activity.limit(OFFICE_FEED_ROWS).agg(F.count(F.lit(1)).alias("activity_shown"))
    rows = online.unionByName(doing, allowMissingColumns=True).unionByName(shown, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("active_agents", "tasks_in_progress", "activity_shown")])


def replies_to_tasks(replies: DataFrame, existing_tasks: DataFrame | None = None) -> DataFrame:
    """Replies as tasks that need an answer. With `existing_tasks`, replies that have one are left out."""
    # The texts of such a task.
    if existing_tasks is not None:
        done = existing_tasks.select(F.col("reply_id").alias("id")).filter("id IS NOT NULL").distinct()
        replies = replies.join(done, "id", "left_anti")
    sender = F.coalesce("from", F.lit("unknown"))
    preview = F.substring(F.coalesce("text", F.lit("")), 1, 200)
    return replies.select(
        F.concat(F.lit("task-"), F.col("id")).alias("id"),
        F.concat(F.lit("Reply from "), sender).alias("title"),
        F.concat(
            F.coalesce("subject", F.lit("(no subject)")), F.lit("\n\n"), preview,
            F.lit("\n\nCampaign: "), F.coalesce("campaign_id", F.lit("—")),
        ).alias("description"),
        F.lit("needs_input").alias("status"),
        F.lit("medium").alias("priority"),
        F.lit("outreach_reply").alias("source"),
        F.col("id").alias("reply_id"),
    )


def reply_preview(replies: DataFrame, n: int = 280) -> DataFrame:
    return replies.select(
        "from", "subject", F.substring(F.coalesce("text", F.lit("")), 1, n).alias("preview"),
        "received_at", "campaign_id",
    )


def webhook_counts(webhooks: DataFrame, events: DataFrame) -> DataFrame:
    """Stored events per webhook and whether it is live."""
    counts = events.groupBy(F.col("webhook_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return webhooks.join(counts, "id", "left").select("id", "name", n.alias("events"), (n > 0).alias("is_live"))


def submission_counts(forms: DataFrame, submissions: DataFrame) -> DataFrame:
    counts = submissions.groupBy(F.col("form_slug").alias("slug")).agg(F.count(F.lit(1)).alias("_n"))
    return forms.join(counts, "slug", "left").select("slug", "title", F.coalesce("_n", F.lit(0)).alias("submissions"))


def normalize_form_fields(forms: DataFrame) -> DataFrame:
    """Fields of new forms completed: label, name, type and the required flag."""
    def complete(f, i):
        number = (i + 1).cast("string")
        label = F.coalesce(f["label"], f["name"], F.concat(F.lit("Field "), number))
        slug = field_slug(F.coalesce(f["name"], label))
        kind = F.lower(F.coalesce(f["type"], F.lit("text")))
        return F.struct(
            F.when(slug != "", slug).otherwise(F.concat(F.lit("field_"), number)).alias("name"),
            label.alias("label"),
            F.when(kind.isin(*FIELD_TYPES), kind).otherwise("text").alias("type"),
            F.coalesce(f["required"], F.lit(False)).alias("required"),
        )

    return forms.withColumn("fields", F.transform("fields", complete))


def tabulate_submissions(forms: DataFrame, submissions: DataFrame) -> DataFrame:
    """Submissions of all forms, one row per field in form order; empty values are null."""
    fields = forms.select(F.col("slug").alias("form_slug"), F.col("fields").alias("_fields"))
    return (
        submissions.join(fields, "form_slug")
        .select(
            "form_slug", F.col("id").alias("submission_id"), "received_at", "data",
            F.posexplode("_fields").alias("position", "_f"),
        )
        .select(
            "form_slug", "submission_id", "received_at", "position",
            F.col("_f.label").alias("label"),
            map_get(F.col("data"), F.col("_f.name")).alias("value"),
        )
    )


def tabulate_form(submissions: DataFrame, form_slug: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Submissions of one form as a wide table, newest first; `fields` are (name, label) pairs."""
    return (
        submissions.filter(F.col("form_slug") == form_slug)
        .orderBy(F.col("received_at").desc_nulls_last(), "id")
        .select("received_at", *[map_get(F.col("data"), name).alias(label) for name, label in fields], "id")
    )
