"""Voice sessions: transcripts, tool calls, invitations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heliograph.functions.text import format_duration, js_round, js_trim


def fold_transcript(chunks: DataFrame, block: int = 10_000) -> DataFrame:
    """`(session_id, seq, role, text, final)` to transcript lines.

    A chunk replaces the line before it while the role stays and that line is not final. So a chunk
    survives exactly if it is final or the next one has another role: looking one row ahead is
    enough. The look-ahead runs in blocks of `block` sequence numbers; the first role of the
    following block comes in as one extra row, and a session of any length is split over tasks.
    """
    rows = chunks.select(
        *chunks.columns, F.floor(F.col("seq") / block).alias("_block"), F.lit(False).alias("_peek")
    )
    firsts = rows.groupBy("session_id", "_block").agg(F.min(F.struct("seq", "role")).alias("_first"))
    back = W.partitionBy("session_id").orderBy(F.col("_block").desc())
    peeks = firsts.select(
        "session_id",
        F.lag("_block").over(back).alias("_after"),
        "_block",
        F.lag("_first").over(back).alias("_next"),
    ).filter(F.col("_next").isNotNull()).select(
        "session_id",
        "_block",
        F.col("_next.seq").alias("seq"),
        F.col("_next.role").alias("role"),
        F.lit(True).alias("_peek"),
    )
    ahead = W.partitionBy("session_id", "_block").orderBy("seq")
    next_role = F.lead("role").over(ahead)
    has_next = F.lead("seq").over(ahead).isNotNull()
    replaced = has_next & next_role.eqNullSafe(F.col("role")) & ~F.coalesce("final", F.lit(False))
    return (
        rows.unionByName(peeks, allowMissingColumns=True)
        .withColumn("_replaced", replaced)
        .filter(~F.col("_peek") & ~F.col("_replaced") & (js_trim(F.col("text")) != ""))
        .select(*chunks.columns)
    )


def merge_tool_calls(calls: DataFrame) -> DataFrame:
    """`(session_id, seq, name, params, result, error)`: equal calls become the first of them, with
    the result and error reported last."""
    reported = F.col("result").isNotNull() | F.col("error").isNotNull()
    return (
        calls.groupBy("session_id", "name", "params")
        .agg(
            F.min("seq").alias("seq"),
            F.max(F.when(reported, F.struct("seq", "result", "error"))).alias("_last"),
        )
        .select(
            "session_id", "seq", "name", "params",
            F.col("_last.result").alias("result"), F.col("_last.error").alias("error"),
        )
    )


def _with_duration(sessions: DataFrame) -> DataFrame:
    millis = F.unix_millis("ended_at") - F.unix_millis("started_at")
    seconds = js_round(millis / 1000)
    return sessions.withColumn("duration_seconds", seconds).withColumn(
        "duration", format_duration(F.col("duration_seconds"))
    )


def _summary_line(first_text: str):
    said = F.coalesce(F.substring(first_text, 1, 80), F.lit("no user input"))
    return F.concat(F.lit("Voice session ("), F.col("duration_seconds").cast("string"), F.lit("s): "), said)


def session_summary(sessions: DataFrame) -> DataFrame:
    """Stored sessions with nested transcripts to one line each."""
    user = F.filter("transcripts", lambda t: t["role"] == "user")
    return (
        _with_duration(sessions)
        .withColumn("first_user_text", F.get(user, F.lit(0))["text"])
        .select(
            "id", "started_at", "duration_seconds", "duration",
            F.size("transcripts").alias("turns"),
            F.coalesce(F.size("tools"), F.lit(0)).alias("tool_calls"),
            "first_user_text",
            _summary_line("first_user_text").alias("summary"),
        )
    )


def session_summary_from_turns(sessions: DataFrame, turns: DataFrame, calls: DataFrame) -> DataFrame:
    """The same from transcript lines and tool calls kept as rows, for sessions of any length."""
    talk = turns.groupBy(F.col("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("turns"),
        F.min(F.when(F.col("role") == "user", F.struct("seq", "text")))["text"].alias("first_user_text"),
    )
    used = calls.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("tool_calls"))
    return (
        _with_duration(sessions)
        .join(talk, "id", "left")
        .join(used, "id", "left")
        .select(
            "id", "started_at", "duration_seconds", "duration",
            F.coalesce("turns", F.lit(0)).alias("turns"),
            F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
            "first_user_text",
            _summary_line("first_user_text").alias("summary"),
        )
    )


def pending_invitations(invitations: DataFrame) -> DataFrame:
    return invitations.filter(F.col("status") == "pending").orderBy(F.col("created_at").desc_nulls_last(), "id")


def session_invitations(sessions: DataFrame, invitations: DataFrame) -> DataFrame:
    """Sessions with the invitation that led to them; a saved session accepts its invitation."""
    asked = invitations.select(
        F.col("id").alias("invitation_id"), "agent_name", "reason", F.col("status").alias("status_before")
    )
    return sessions.join(asked, "invitation_id", "left").select(
        F.col("id").alias("session_id"),
        "invitation_id",
        "agent_name",
        "reason",
        "status_before",
        F.when(F.col("status_before").isNotNull(), "accepted").alias("status_after"),
        F.when(F.col("status_before").isNotNull(), F.col("ended_at")).alias("accepted_at"),
    )
