"""Fixed schemas of the stored entities. Missing keys read as null; defaults are applied at use."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "agents": """id STRING, name STRING, sign_in_name STRING, role STRING, emoji STRING, color STRING,
        status STRING, last_heartbeat TIMESTAMP, created_at TIMESTAMP""",
    "tasks": """id STRING, title STRING, description STRING, status STRING, assignee_id STRING,
        priority STRING, source STRING, reply_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "activity": """id STRING, agent_id STRING, category STRING, summary STRING, details STRING,
        created_at TIMESTAMP""",
    "forms": """slug STRING, title STRING, description STRING,
        fields ARRAY<STRUCT<name: STRING, label: STRING, type: STRING, required: BOOLEAN>>,
        created_at TIMESTAMP""",
    "submissions": "id STRING, form_slug STRING, data MAP<STRING, STRING>, received_at TIMESTAMP",
    "webhooks": """id STRING, name STRING, description STRING, service STRING, event_count BIGINT,
        created_at TIMESTAMP""",
    "webhook_events": """id STRING, webhook_id STRING, headers MAP<STRING, STRING>, body STRING,
        received_at TIMESTAMP""",
    "campaigns": """id STRING, name STRING, query STRING, status STRING,
        structured_query STRUCT<location: STRING, searchTerms: ARRAY<STRING>, maxResults: INT>,
        total_leads_found BIGINT, leads_imported BIGINT, emails_generated BIGINT, emails_sent BIGINT,
        emails_delivered BIGINT, emails_bounced BIGINT, emails_clicked BIGINT, emails_replied BIGINT,
        default_framework STRING, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "leads": """id STRING, campaign_id STRING, name STRING, company STRING, email STRING, phone STRING,
        website STRING, address STRING, category STRING, rating DOUBLE, reviews_count BIGINT,
        maps_url STRING, notes STRING, raw STRING, status STRING, is_test BOOLEAN,
        tags ARRAY<STRING>, created_at TIMESTAMP""",
    "emails": """id STRING, campaign_id STRING, lead_id STRING, to_email STRING, to_name STRING,
        subject STRING, body_text STRING, body_html STRING, framework STRING, sequence_position INT,
        sequence_total INT, source STRING, status STRING, click_count BIGINT,
        agentmail_message_id STRING, agentmail_thread_id STRING, sent_at TIMESTAMP,
        last_clicked_at TIMESTAMP, replied_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "clicks": """id STRING, campaign_id STRING, lead_id STRING, email_id STRING, url STRING,
        user_agent STRING, ip STRING, clicked_at TIMESTAMP""",
    "replies": """id STRING, campaign_id STRING, lead_id STRING, original_email_id STRING,
        agentmail_message_id STRING, agentmail_thread_id STRING, from STRING, to ARRAY<STRING>,
        subject STRING, text STRING, html STRING, received_at TIMESTAMP, handled BOOLEAN""",
    "pages": """slug STRING, title STRING, html_body STRING, theme STRING, linked_form_slug STRING,
        accent STRING, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "voice_sessions": """id STRING, started_at TIMESTAMP, ended_at TIMESTAMP, duration_seconds BIGINT,
        transcripts ARRAY<STRUCT<role: STRING, text: STRING, final: BOOLEAN>>,
        tools ARRAY<STRUCT<name: STRING, params: STRING, result: STRING, error: STRING>>,
        invitation_id STRING""",
    "invitations": """id STRING, agent_name STRING, agent_id STRING, reason STRING, context STRING,
        status STRING, created_at TIMESTAMP, accepted_at TIMESTAMP""",
}

# Body of one mail-provider webhook call. Each lifecycle event nests its ids under its own key.
_CARRIER = "STRUCT<message_id: STRING, thread_id: STRING, inbox_id: STRING>"
PROVIDER_EVENT_DDL = f"""event_type STRING, event_id STRING,
    send {_CARRIER}, delivery {_CARRIER}, bounce {_CARRIER}, complaint {_CARRIER}, rejection {_CARRIER},
    message STRUCT<message_id: STRING, thread_id: STRING, subject: STRING, from: STRING,
        to: ARRAY<STRING>, text: STRING, html: STRING, timestamp: STRING>"""

ENTITIES = tuple(_DDL)

# How each store is partitioned on disk; the key is the leading part of the document key.
PARTITION_KEYS = {
    "submissions": "form_slug",
    "webhook_events": "webhook_id",
    "leads": "campaign_id",
    "emails": "campaign_id",
    "clicks": "campaign_id",
    "replies": "campaign_id",
}


def schema_of(entity: str) -> StructType:
    """The StructType of one entity."""
    return StructType.fromDDL(_DDL[entity])
