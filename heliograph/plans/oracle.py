"""The registered queries in plain SQL, written independently of the Spark plans.

`VIEWS` are the domain tables again, for DuckDB; each statement pulls in the ones it names.
"""

from __future__ import annotations

import re

_WS = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _token(c: str, lead: str, e: str, u: str) -> str:
    payload = f"to_json({{'c': {c}, 'l': {lead}, 'e': {e}, 'u': {u}}})"
    return f"replace(replace(rtrim(to_base64(encode(CAST({payload} AS VARCHAR))), '='), '+', '-'), '/', '_')"


def _rewritten(html: str, c: str, lead: str, e: str) -> str:
    """HTML with tracked links: pieces around the links, zipped with the rewritten links."""
    pattern = "(?i)href=\"[^\"]+\""
    url = "x[2][7:-2]"
    link = (
        f"CASE WHEN x[2] IS NULL THEN '' WHEN regexp_matches({url}, '(?i)^(#|mailto:|tel:|sms:)')"
        f" OR starts_with({url}, 'https://track.test/t/') THEN x[2]"
        f" ELSE 'href=\"https://track.test/t/' || {_token(c, lead, e, url)} || '\"' END"
    )
    return (
        f"array_to_string([x[1] || {link} for x in list_zip(regexp_split_to_array({html}, '{pattern}'),"
        f" regexp_extract_all({html}, '{pattern}'))], '')"
    )


VIEWS = {
    "campaigns": """
        SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'find ' || lower(n_name) AS query,
          CASE n_nationkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'searching' ELSE 'ready' END AS status,
          10 + n_nationkey * 2 AS max_results,
          CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey * 10 AS BIGINT) END AS leads_imported,
          CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 100 AS BIGINT) END AS emails_sent,
          CAST(n_nationkey * 60 AS BIGINT) AS emails_delivered, CAST(n_nationkey * 7 AS BIGINT) AS emails_bounced,
          CAST(n_nationkey * 30 AS BIGINT) AS emails_clicked, CAST(n_nationkey * 11 AS BIGINT) AS emails_replied,
          CASE WHEN n_nationkey % 2 = 0 THEN 'pas' END AS default_framework,
          TIMESTAMP '2024-01-01 00:00:00' + to_days(n_nationkey) AS created_at
        FROM nation""",
    "leads": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS campaign_id, c_name AS name,
          CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'Co ' || c_name END AS company,
          CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''
            ELSE replace(lower(c_name), '#', '.') || '@example.org' END AS email,
          CASE WHEN c_custkey % 3 <> 0 THEN 'https://SRC' || c_custkey % 25 || '/home' END AS website,
          'City ' || c_nationkey AS address, c_mktsegment AS category,
          CASE WHEN c_custkey % 4 = 0 THEN 'note ' || c_custkey END AS notes,
          c_custkey % 97 = 0 AS is_test, TIMESTAMP '2024-02-01 00:00:00' AS created_at
        FROM customer""",
    "emails": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS campaign_id,
          CAST(o_custkey AS VARCHAR) AS lead_id,
          replace(lower(c_name), '#', '.') || '@example.org' AS to_email, c_name AS to_name,
          'Offer ' || o_orderkey AS subject, 'Hello ' || c_name || chr(10) || 'Priority ' || o_orderpriority AS body_text,
          CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '<p><a HREF="https://shop.test/?o=' || o_orderkey
            || '">go</a> <a href="mailto:a@b.test">m</a></p>' END AS body_html,
          CASE o_orderkey % 4 WHEN 0 THEN 'pas' WHEN 1 THEN 'aida' WHEN 2 THEN 'sdr' END AS framework,
          CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 3 + 1 AS INTEGER) END AS sequence_position,
          CASE WHEN o_orderkey % 50 = 0 THEN 'agent_drafted' END AS source,
          CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'O' THEN 'bounced' ELSE 'replied' END
            WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN o_orderstatus = 'O' THEN 'complained' ELSE 'clicked' END
            WHEN o_orderpriority = '3-MEDIUM' THEN CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'P' THEN 'delivered' ELSE 'sent' END
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'O' THEN 'delivered' WHEN 'P' THEN 'sent' END
            ELSE CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'drafted' END END AS status,
          'm' || o_orderkey AS message_id, 't' || o_custkey AS thread_id, o_orderdate AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "clicks": """
        SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_suppkey % 25 AS VARCHAR) AS campaign_id,
          CAST(l_partkey AS VARCHAR) AS lead_id, CAST(l_orderkey AS VARCHAR) AS email_id,
          'https://shop.test/p/' || l_partkey AS url, l_shipdate AS clicked_at, l_linenumber AS line
        FROM lineitem""",
    "clicked_emails": """
        SELECT e.*, coalesce(k.n, 0) AS click_count FROM emails e
        LEFT JOIN (SELECT email_id, count(*) AS n FROM clicks GROUP BY email_id) k ON k.email_id = e.id""",
    "lifecycle": """
        SELECT CAST(user_id AS VARCHAR) AS email_id, CAST(user_id % 25 AS VARCHAR) AS campaign_id, ts AS "at",
          CAST(event_id AS VARCHAR) AS event_id,
          CASE event_type WHEN 'signup' THEN 'sent' WHEN 'view' THEN 'delivered' WHEN 'click' THEN 'clicked'
            WHEN 'purchase' THEN 'replied' ELSE 'bounced' END AS status,
          CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'ack' WHEN event_type = 'click' THEN 'click'
            WHEN event_type = 'purchase' THEN 'reply' ELSE 'provider' END AS kind
        FROM events""",
    "ranked": """
        SELECT *, kind = 'ack' OR status = 'bounced' AS is_reset,
          CASE status WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'clicked' THEN 3 WHEN 'replied' THEN 4 ELSE 0 END AS rnk,
          sum(CASE WHEN kind = 'ack' OR status = 'bounced' THEN 1 ELSE 0 END)
            OVER (PARTITION BY email_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS seg
        FROM lifecycle""",
    "marked": """
        SELECT email_id, campaign_id, "at", event_id, status, kind,
          is_reset OR rnk >= coalesce(max(rnk) OVER (PARTITION BY email_id, seg ORDER BY "at", event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied
        FROM ranked""",
    "folded": """
        SELECT email_id,
          CASE WHEN max(rnk) > 0 THEN CASE max(rnk) WHEN 1 THEN 'sent' WHEN 2 THEN 'delivered' WHEN 3 THEN 'clicked' ELSE 'replied' END
            ELSE coalesce(max(status), 'drafted') END AS status
        FROM (SELECT *, max(seg) OVER (PARTITION BY email_id) AS last_seg FROM ranked) WHERE seg = last_seg GROUP BY email_id""",
    "calls": """
        SELECT CAST(event_id AS VARCHAR) AS id, event_id AS n, 'w' || user_id % 7 AS webhook_id, event_type AS agent, ts AS received_at,
          event_id % 10 <> 0 AS is_json,
          CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_type = 'signup' THEN 'message.sent'
            WHEN event_type = 'view' THEN 'message.delivered' WHEN event_type = 'purchase' THEN 'message.received'
            WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'message.bounced' WHEN 1 THEN 'message.complained'
              ELSE 'message.rejected' END END AS event_type,
          'm' || event_id AS message_id, 't' || user_id AS thread_id, CAST(event_id % 9000 AS VARCHAR) AS provider_event_id,
          CASE event_type WHEN 'signup' THEN 'send' WHEN 'view' THEN 'delivery' WHEN 'purchase' THEN 'message' ELSE
            CASE event_id % 3 WHEN 0 THEN 'bounce' WHEN 1 THEN 'complaint' ELSE 'rejection' END END AS carrier,
          props
        FROM events""",
    "webhooks": """
        SELECT 'w' || r_regionkey AS id, r_name AS name,
          CASE WHEN r_regionkey % 2 = 0 THEN 'agentmail' WHEN r_regionkey = 1 THEN 'generic' END AS service
        FROM region""",
    "replies": """
        SELECT 'r' || conv_id || '-' || turn AS id,
          CASE WHEN conv_id % 9 <> 0 THEN 't' || conv_id * 20 END AS thread_id,
          CASE WHEN conv_id % 8 <> 0 THEN 'user' || conv_id || '@example.org' END AS sender,
          CASE WHEN turn % 4 <> 0 THEN 'Re: ' || role || ' ' || conv_id END AS subject, text,
          TIMESTAMP '2024-03-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS received_at
        FROM conversations""",
    "matched_replies": """
        SELECT r.*, e.campaign_id, e.lead_id, e.email_id FROM replies r LEFT JOIN (
          SELECT thread_id, campaign_id, lead_id, id AS email_id FROM emails
          QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY campaign_id, created_at, id) = 1
        ) e ON e.thread_id = r.thread_id""",
    "activity": """
        SELECT 'a' || event_id AS id, event_id AS n, user_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS agent_id,
          CASE event_type WHEN 'signup' THEN 'content' WHEN 'view' THEN 'research' WHEN 'click' THEN 'email'
            WHEN 'purchase' THEN 'mystery' ELSE 'error' END AS category,
          CASE WHEN event_id % 3 = 0 THEN 'Landing Page ' || event_id || ' published'
            ELSE 'Did ' || event_type || ' ' || event_id END AS summary,
          CASE event_id % 8 WHEN 0 THEN '{"campaign_id":"' || user_id || '","reply_id":"r"}'
            WHEN 1 THEN '{"campaign_id":"","reply_id":"r1"}' WHEN 2 THEN '{"slug":"s' || user_id || '"}'
            WHEN 3 THEN '{"task_id":"t1"}' WHEN 4 THEN '{"session_id":"v1"}' WHEN 5 THEN '{"invitation_id":"i1"}'
            WHEN 6 THEN props END AS details,
          ts AS created_at
        FROM events""",
    "agents": """
        SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, replace(lower(s_name), '#', '-') AS sign_in_name,
          CASE WHEN s_suppkey % 5 <> 0 THEN 'e' || s_suppkey % 7 END AS emoji,
          CASE s_suppkey % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'idle' WHEN 2 THEN 'offline' ELSE 'error' END AS status,
          CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS last_heartbeat,
          TIMESTAMP '2023-12-01 00:00:00' AS created_at
        FROM supplier""",
    "tasks": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS title,
          CASE WHEN o_orderstatus = 'P' THEN 'blocked' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing'
            WHEN 2 THEN 'needs_input' WHEN 3 THEN 'canceled' WHEN 4 THEN 'done' END END AS status,
          CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS assignee_id, o_orderdate AS created_at
        FROM orders""",
    "forms": "SELECT 'form-' || p_partkey AS slug, p_name AS title, p_partkey AS n FROM part",
    "form_fields": """
        SELECT slug, n, 0 AS position, 'k' AS name, 'Key' AS label, 'number' AS type, true AS required FROM forms
        UNION ALL SELECT slug, n, 1,
          regexp_replace(regexp_replace(lower(title), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), title || '!', 'text', false FROM forms
        UNION ALL SELECT slug, n, 2, CASE WHEN n % 2 = 0 THEN 'e_mail' ELSE 'field_3' END,
          CASE WHEN n % 2 = 0 THEN ' E-Mail ' ELSE 'Field 3' END,
          CASE WHEN n % 3 <> 0 THEN 'email' ELSE 'text' END, n % 5 = 0 FROM forms""",
    "submissions": """
        SELECT 's' || event_id AS id, f.slug AS form_slug,
          CASE WHEN event_id % 6 <> 0 THEN json_extract_string(props, '$.k') END AS k,
          CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'a@b.test' ELSE '' END AS e_mail,
          ts AS received_at
        FROM events JOIN forms f ON f.slug = 'form-' || user_id * 3 WHERE event_id % 6 <> 1""",
    "site_pages": """
        SELECT 'page-' || page_id AS slug, 'Page ' || page_id AS title, page_id, html,
          CASE WHEN page_id % 3 = 0 THEN 'form-' || page_id * 11 END AS linked_form_slug
        FROM pages""",
    "crawl": """
        SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS site,
          CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/contact' WHEN 2 THEN '/contact-us' ELSE '/p/' || page_id END AS path,
          html || CASE page_id % 9 WHEN 0 THEN '<img src="logo@2x.png">'
            WHEN 1 THEN '<a href="MAILTO:Jo' || page_id || '@Firm.test?subject=x">'
            WHEN 2 THEN 'test@firm.test hello@firm.test' WHEN 3 THEN 'a@b.wixsite.com'
            WHEN 4 THEN 'x' || page_id || '@firm.test or Info@firm.test' ELSE '' END AS content
        FROM pages
        UNION ALL SELECT source, '/d/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'),
          text || CASE WHEN doc_id % 70 = 3 THEN ' mail Doc' || doc_id || '@' || source || '.test' ELSE '' END FROM documents""",
    "hits": r"""
        SELECT site, path, CASE path WHEN '' THEN 0 WHEN '/contact' THEN 1 WHEN '/contact-us' THEN 2 ELSE 3 END AS rnk,
          [a for a, i in all_hits if list_position(all_hits, a) = i] AS found
        FROM (SELECT site, path, [lower(x) for x in list_concat(
            regexp_extract_all(content, '(?i)mailto:([^"''?\s>]+)', 1),
            regexp_extract_all(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))] AS all_hits FROM crawl)""",
    "scraped": """
        SELECT CAST(c_nationkey AS VARCHAR) AS campaign_id, c_custkey AS item_no,
          CASE WHEN c_custkey % 7 = 0 THEN 'Sub ' || c_custkey WHEN c_custkey % 7 = 1 THEN 'Unknown' ELSE c_name END AS name,
          CASE WHEN c_custkey % 4 = 0 THEN 'a@b.test' END AS email,
          CASE c_custkey % 3 WHEN 0 THEN '+1' || c_custkey WHEN 1 THEN '' END AS phone,
          CASE WHEN c_custkey % 8 = 0 THEN 'https://w' || c_custkey || '.test' END AS website,
          CAST(NULL AS VARCHAR) AS address,
          CASE WHEN c_custkey % 2 = 0 THEN 'Shop' ELSE c_mktsegment END AS category,
          CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 5 AS DOUBLE) END AS rating,
          CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 100 END AS reviews_count,
          CAST(NULL AS VARCHAR) AS maps_url
        FROM customer""",
    "planned": """
        SELECT campaign_id, id AS lead_id, step FROM leads, (SELECT unnest([1, 2, 3]) AS step)
        WHERE email <> '' AND NOT EXISTS (
          SELECT 1 FROM emails e WHERE e.campaign_id = leads.campaign_id AND e.lead_id = leads.id AND coalesce(e.sequence_position, 1) = step)""",
    "chunks": """
        SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CASE WHEN turn % 4 < 2 THEN 'user' ELSE 'agent' END AS role,
          CASE WHEN turn % 7 = 5 THEN ' ' || chr(10) ELSE text END AS text, turn % 3 = 0 AS final
        FROM conversations""",
    "transcript": f"""
        SELECT session_id, max(seq) AS seq, arg_max(role, seq) AS role, arg_max(text, seq) AS text, arg_max(final, seq) AS final
        FROM (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND NOT lag(final) OVER w THEN 0 ELSE 1 END AS starts
          FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY seq)))
        GROUP BY session_id, island HAVING {_trim("arg_max(text, seq)")} <> ''""",
    "tool_calls": """
        SELECT CAST(user_id % 97 AS VARCHAR) AS session_id, event_id AS seq, event_type AS name,
          '{"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 || '}' AS params,
          CASE WHEN event_id % 3 = 0 THEN 'result ' || event_id END AS result,
          CASE WHEN event_id % 7 = 0 THEN 'error ' || event_id END AS error
        FROM events""",
    "merged_calls": """
        SELECT c.session_id, f.seq, c.name, c.params, l.result, l.error
        FROM (SELECT DISTINCT session_id, name, params FROM tool_calls) c
        JOIN (SELECT session_id, name, params, min(seq) AS seq FROM tool_calls GROUP BY ALL) f USING (session_id, name, params)
        LEFT JOIN (SELECT * FROM tool_calls WHERE result IS NOT NULL OR error IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY session_id, name, params ORDER BY seq DESC) = 1) l USING (session_id, name, params)""",
    "sessions": """
        SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 3 <> 0 THEN 'i' || conv_id % 150 END AS invitation_id,
          TIMESTAMP '2024-04-01 00:00:00' + to_minutes(conv_id) AS started_at,
          TIMESTAMP '2024-04-01 00:00:00' + to_minutes(conv_id) + to_milliseconds(CAST(max(turn) * 13500 AS BIGINT)) AS ended_at
        FROM conversations GROUP BY conv_id""",
    "invitations": """
        SELECT 'i' || s_suppkey AS id, s_name AS agent_name, CAST(s_suppkey AS VARCHAR) AS agent_id, 'about nation ' || s_nationkey AS reason,
          CASE s_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'dismissed' END AS status,
          TIMESTAMP '2024-03-01 00:00:00' + to_days(s_nationkey) AS created_at
        FROM supplier""",
    "matched_log": """
        SELECT email_id, campaign_id, received_at AS "at", event_id, status, 'provider' AS kind FROM (
          SELECT c.id AS event_id, c.received_at, e.id AS email_id, e.campaign_id, CASE c.event_type WHEN 'message.sent' THEN 'sent'
            WHEN 'message.delivered' THEN 'delivered' WHEN 'message.bounced' THEN 'bounced' WHEN 'message.complained' THEN 'complained'
            ELSE 'failed' END AS status
          FROM (SELECT c.*, e.id AS eid FROM calls c JOIN emails e ON e.message_id = c.message_id
            UNION ALL SELECT c.*, e.id FROM calls c JOIN emails e ON e.thread_id = c.thread_id) c
          JOIN emails e ON e.id = c.eid JOIN webhooks w ON w.id = c.webhook_id
          WHERE c.event_type <> 'message.received'
          QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY e.campaign_id, e.created_at, e.id) = 1)
        UNION ALL SELECT email_id, campaign_id, arrived_at, id, 'replied', 'reply' FROM called_replies WHERE email_id IS NOT NULL
        UNION ALL SELECT email_id, campaign_id, received_at, id, 'replied', 'reply' FROM matched_replies WHERE email_id IS NOT NULL
        UNION ALL SELECT k.email_id, k.campaign_id, k.clicked_at, k.id, 'clicked', 'click' FROM clicks k
          JOIN emails e ON e.campaign_id = k.campaign_id AND e.id = k.email_id""",
    "called_replies": """
        SELECT 'reply-' || c.id AS id, e.campaign_id, e.lead_id, e.email_id, c.thread_id, 'm' || c.n AS message_id,
          'user' || c.user_id || '@example.org' AS sender, 'Re: ' || c.n AS subject, 'text of ' || c.n AS text,
          c.received_at - to_seconds(c.n % 400) AS received_at, c.received_at AS arrived_at
        FROM (SELECT *, CAST(substring(thread_id, 2) AS BIGINT) AS user_id FROM calls WHERE event_type = 'message.received') c
        JOIN webhooks w ON w.id = c.webhook_id LEFT JOIN (
          SELECT thread_id, campaign_id, lead_id, id AS email_id FROM emails
          QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY campaign_id, created_at, id) = 1
        ) e ON e.thread_id = c.thread_id""",
    "counted": """
        SELECT campaign_id, count(*) FILTER (status <> '' AND status <> 'drafted') AS emails_sent,
          count(*) FILTER (status IN ('delivered', 'clicked', 'replied')) AS emails_delivered,
          count(*) FILTER (status IN ('bounced', 'complained', 'failed')) AS emails_bounced,
          count(*) FILTER (coalesce(status, '') IN ('clicked', 'replied') OR click_count > 0) AS emails_clicked,
          count(*) FILTER (status = 'replied') AS emails_replied
        FROM clicked_emails GROUP BY campaign_id""",
    "summary": """
        SELECT c.id, c.name, c.created_at, c.leads_imported, coalesce(k.emails_sent, 0) AS emails_sent,
          coalesce(k.emails_delivered, 0) AS emails_delivered, coalesce(k.emails_bounced, 0) AS emails_bounced,
          coalesce(k.emails_clicked, 0) AS emails_clicked, coalesce(k.emails_replied, 0) AS emails_replied
        FROM campaigns c LEFT JOIN counted k ON k.campaign_id = c.id""",
    "steps": """
        SELECT campaign_id, coalesce(sequence_position, 1) AS step, count(*) FILTER (status = 'drafted') AS drafted,
          count(*) FILTER (status IS DISTINCT FROM 'drafted') AS sent,
          count(*) FILTER (status IN ('delivered', 'clicked', 'replied')) AS delivered,
          count(*) FILTER (coalesce(status, '') IN ('clicked', 'replied') OR click_count > 0) AS clicked,
          count(*) FILTER (status = 'replied') AS replied
        FROM clicked_emails GROUP BY ALL""",
    "grid": """
        SELECT campaign_id, last, CAST(unnest(range(1, last + 1)) AS INTEGER) AS step
        FROM (SELECT campaign_id, max(step) AS last FROM steps GROUP BY campaign_id)""",
}

_CONTACT_SELECT = r"""
    SELECT site, count(*) AS pages, first_page.path AS found_on, CAST(coalesce(len(first_page.found), 0) AS INTEGER) AS raw_hits,
      coalesce([a for a in kept if regexp_matches(a, '^(info|contact|hello|hi|admin|sales|office|reception|enquiries|inquiries|support)@')][1], kept[1]) AS email
    FROM (SELECT h.*, f.first_page, [a for a in f.first_page.found if regexp_matches(a, '^[^@\s]+@[^@\s]+\.[^@\s]{2,}$')
          AND NOT regexp_matches(a, '\.(png|jpg|jpeg|gif|webp|svg|ico)$')
          AND NOT regexp_matches(a, '^(example|sentry|wixpress|wix|youremail|test)@')
          AND NOT regexp_matches(a, '\.(example|wixsite|sentry)\.')] AS kept
      FROM hits h LEFT JOIN (SELECT site, {'path': path, 'found': found} AS first_page FROM hits WHERE len(found) > 0 AND (%(where)s)
        QUALIFY row_number() OVER (PARTITION BY site ORDER BY rnk, path, found) = 1) f USING (site) WHERE %(where)s)
    GROUP BY site, first_page, kept"""

VIEWS["contacts"] = _CONTACT_SELECT % {"where": "true"}

_CALL_BODY = """CASE WHEN n % 10 = 0 THEN 'not json ' || n WHEN event_type IS NULL THEN props
    WHEN carrier = 'message' THEN '{"event_type":"message.received","event_id":"' || provider_event_id || '","message":{"message_id":"'
      || message_id || '","thread_id":"' || thread_id || '","from":"user' || substring(thread_id, 2) || '@example.org","subject":"Re: '
      || n || '","text":"text of ' || n || '","timestamp":"' || strftime(received_at - to_seconds(n % 400), '%Y-%m-%dT%H:%M:%S.%fZ') || '"}}'
    ELSE '{"event_type":"' || event_type || '","event_id":"' || provider_event_id || '","' || carrier || '":{"message_id":"'
      || message_id || '","thread_id":"' || thread_id || '"}}' END"""

_WEBHOOK_FEED = """SELECT 'webhook-' || e.id AS id, CAST(NULL AS VARCHAR) AS agent_id, 'system' AS category,
      'Webhook "' || w.name || '" received an event' AS summary,
      '{"event_id":"' || e.id || '","service":"' || coalesce(w.service, 'generic') || '"}' AS details, e.received_at AS created_at
    FROM calls e JOIN webhooks w ON w.id = e.webhook_id"""

_CLICK_FEED = """SELECT 'click-' || k.id AS id, CAST(NULL AS VARCHAR) AS agent_id, 'email' AS category,
      'Link clicked in campaign ' || coalesce(c.name, k.campaign_id) AS summary,
      '{"campaign_id":"' || k.campaign_id || '","email_id":"' || k.email_id || '","url":"' || k.url || '"}' AS details,
      k.clicked_at AS created_at
    FROM clicks k LEFT JOIN campaigns c ON c.id = k.campaign_id"""

# Every event judged against what was stored before it, one after the other: `judged`; what is left: `tail`.
_SEEDED = """
        WITH r AS (SELECT l.*, CASE l.status WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'clicked' THEN 3 WHEN 'replied' THEN 4 ELSE 0 END AS rnk,
          CASE e.status WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'clicked' THEN 3 WHEN 'replied' THEN 4 ELSE 0 END AS stored, e.status AS before,
          l.status IN ('bounced', 'complained', 'failed') AS resets,
          sum(CASE WHEN l.status IN ('bounced', 'complained', 'failed') THEN 1 ELSE 0 END)
            OVER (PARTITION BY l.email_id ORDER BY l."at", l.event_id ROWS UNBOUNDED PRECEDING) AS seg
          FROM matched_log l JOIN emails e ON e.id = l.email_id),
        judged AS (SELECT *, resets OR rnk >= greatest(CASE WHEN seg = 0 THEN stored ELSE 0 END,
          coalesce(max(rnk) OVER (PARTITION BY email_id, seg ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS applied FROM r),
        tail AS (SELECT email_id, coalesce(arg_max(status, ("at", event_id)) FILTER (applied), any_value(before)) AS status,
          count(*) FILTER (kind = 'click') AS clicks, max("at") FILTER (kind = 'click') AS last_clicked_at,
          max("at") FILTER (applied AND status = 'sent') AS sent_at, max("at") FILTER (applied AND status = 'delivered') AS delivered_at,
          max("at") FILTER (applied AND status = 'bounced') AS bounced_at, max("at") FILTER (applied AND status = 'complained') AS complained_at,
          max("at") FILTER (applied AND status = 'failed') AS failed_at FROM judged GROUP BY email_id),
        replied AS (SELECT email_id, arg_max(received_at, (arrived, id)) AS received_at FROM (
          SELECT email_id, received_at, arrived_at AS arrived, id FROM called_replies
          UNION ALL SELECT email_id, received_at, received_at, id FROM matched_replies) GROUP BY email_id)"""

_STATEMENTS = {
    "parse_webhook_events": f"SELECT id, webhook_id, is_json, event_type, agent, {_CALL_BODY} AS body, received_at FROM calls",
    "decode_click_tokens": """SELECT id, clicked_at, campaign_id, lead_id, CASE WHEN line <> 3 THEN email_id END AS email_id,
        url, line <> 3 AS logged FROM clicks WHERE line NOT IN (1, 2)""",
    "parse_submissions": "SELECT * FROM submissions",
    "import_scraped_leads": """SELECT 'lead-' || s.campaign_id || '-' || rn AS id, s.* EXCLUDE (item_no, rn, max_results),
        'new' AS status, false AS is_test FROM (SELECT s.*, c.max_results, row_number() OVER (PARTITION BY s.campaign_id ORDER BY item_no) AS rn
        FROM scraped s JOIN campaigns c ON c.id = s.campaign_id) s WHERE rn <= max_results""",
    "normalize_leads": "SELECT * FROM scraped",
    "lead_count": "SELECT campaign_id, count(*) AS leads FROM leads GROUP BY campaign_id",
    "normalize_search_plan": """
        SELECT plan_id, location, CAST(to_json(terms) AS VARCHAR) AS search_terms, max_results,
          greatest(5, least(200, CAST(ceil(max_results / len(terms)) AS INTEGER))) AS per_term
        FROM (SELECT p_partkey AS plan_id, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Unknown' END AS location,
          CASE p_partkey % 4 WHEN 1 THEN string_split(p_name, ' ') WHEN 2 THEN ['a', 'b', 'c', 'd', 'e']
            ELSE [substring('wanted: ' || repeat(p_name, 12), 1, 80)] END AS terms,
          greatest(10, least(200, CAST(floor(CASE WHEN p_partkey % 5 <> 0 THEN p_size * 7.5 - 10
            WHEN p_partkey % 2 = 0 THEN p_size ELSE 50 END + 0.5) AS INTEGER))) AS max_results
          FROM part)""",
    "extract_contact_emails": _CONTACT_SELECT % {"where": "true"},
    "extract_contact_emails_known_paths": _CONTACT_SELECT % {"where": "rnk < 3"},
    "enrich_leads": """
        SELECT l.id, CASE WHEN coalesce(l.email, '') = '' THEN coalesce(c.email, l.email) ELSE l.email END AS email,
          coalesce(l.email, '') = '' AND c.email IS NOT NULL AS enriched,
          CASE WHEN coalesce(l.email, '') <> '' THEN 'already had email' WHEN l.website IS NULL THEN 'no website to scrape'
            WHEN c.email IS NULL THEN 'no email found on website' END AS reason
        FROM leads l LEFT JOIN contacts c ON c.site = lower(regexp_extract(l.website, '//([^/]+)', 1))""",
    "enrichment_report": """SELECT l.campaign_id, count(*) AS attempted, count(c.email) AS found, count(c.email) / count(*) AS hit_rate
        FROM leads l LEFT JOIN contacts c ON c.site = lower(regexp_extract(l.website, '//([^/]+)', 1))
        WHERE coalesce(l.email, '') = '' AND l.website IS NOT NULL GROUP BY l.campaign_id""",
    "extract_message_ids": """SELECT id, CASE WHEN event_type <> 'message.received' THEN message_id END AS message_id,
        CASE WHEN event_type <> 'message.received' THEN thread_id END AS thread_id FROM calls""",
    "route_events": """SELECT c.id, c.webhook_id, c.event_type FROM calls c JOIN webhooks w ON w.id = c.webhook_id
        WHERE w.service = 'agentmail' OR c.event_type LIKE 'message.%'""",
    "classify_event": """SELECT id, CASE event_type WHEN 'message.sent' THEN 'sent' WHEN 'message.delivered' THEN 'delivered'
        WHEN 'message.bounced' THEN 'bounced' WHEN 'message.complained' THEN 'complained' ELSE 'failed' END AS status
        FROM calls WHERE event_type IS NOT NULL AND event_type <> 'message.received'""",
    "correlate_events": """
        WITH ev AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 <> 0 THEN 'm' || event_id END AS message_id,
          CASE WHEN event_id % 20 <> 0 THEN 't' || user_id END AS thread_id, ts AS received_at FROM events),
        pairs AS (SELECT ev.*, e.id AS email_id, e.campaign_id, e.lead_id, e.created_at FROM ev JOIN emails e ON e.message_id = ev.message_id
          UNION ALL SELECT ev.*, e.id, e.campaign_id, e.lead_id, e.created_at FROM ev JOIN emails e ON e.thread_id = ev.thread_id)
        SELECT id, message_id, thread_id, received_at, email_id, campaign_id, lead_id FROM pairs
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY campaign_id, created_at, email_id) = 1""",
    "correlate_replies": """SELECT id, campaign_id, lead_id, email_id AS original_email_id,
        coalesce(campaign_id, 'unassigned') AS partition, received_at FROM matched_replies""",
    "attribute_clicks": """SELECT k.* EXCLUDE (line), e.id IS NOT NULL AS matched,
        CASE WHEN e.id IS NULL THEN NULL WHEN e.status = 'replied' THEN 'replied' ELSE 'clicked' END AS status_after
        FROM clicks k LEFT JOIN emails e ON e.campaign_id = k.campaign_id AND e.id = k.email_id""",
    "click_stats": "SELECT email_id, count(*) AS click_count, max(clicked_at) AS last_clicked_at FROM clicks GROUP BY email_id",
    "orphans": "SELECT id, webhook_id, received_at FROM calls WHERE webhook_id NOT IN (SELECT id FROM webhooks)",
    "orphan_emails": "SELECT id, campaign_id FROM emails WHERE campaign_id IN (SELECT id FROM campaigns WHERE status = 'draft')",
    "dedupe_deliveries": """SELECT id, CASE WHEN event_type IS NOT NULL THEN provider_event_id END AS event_id, received_at FROM calls
        QUALIFY row_number() OVER (PARTITION BY CASE WHEN event_type IS NOT NULL THEN provider_event_id ELSE 'own ' || id END
          ORDER BY received_at, id) = 1""",
    "fold_email_status": """SELECT l.email_id, f.status, count(*) FILTER (l.kind = 'click') AS click_count,
        max(l."at") FILTER (l.kind = 'click') AS last_clicked_at, max(l."at") AS last_event_at, count(*) AS events
        FROM lifecycle l JOIN folded f USING (email_id) GROUP BY l.email_id, f.status""",
    "applied_events": """SELECT email_id, "at", event_id, status, kind FROM marked WHERE applied""",
    "status_times": "SELECT email_id, " + ", ".join(
        f"max(\"at\") FILTER (status = '{s}') AS {s}_at"
        for s in ("sent", "delivered", "bounced", "complained", "failed", "clicked", "replied")
    ) + " FROM marked WHERE applied GROUP BY email_id",
    "event_counters": """SELECT campaign_id, count(*) FILTER (kind = 'provider' AND applied AND status = 'delivered') AS emails_delivered,
        count(*) FILTER (kind = 'provider' AND applied AND status = 'bounced') AS emails_bounced,
        count(*) FILTER (kind = 'click') AS emails_clicked, count(*) FILTER (kind = 'reply') AS emails_replied FROM marked GROUP BY campaign_id""",
    "lifecycle_events": "SELECT * FROM matched_log",
    "emails_with_status": f"""
        {_SEEDED}
        SELECT e.id, coalesce(t.status, e.status) AS status, nullif(coalesce(t.clicks, 0), 0) AS click_count, t.last_clicked_at,
          t.sent_at, t.delivered_at, t.bounced_at, t.complained_at, t.failed_at,
          (SELECT max(received_at) FROM replied WHERE replied.email_id = e.id) AS replied_at
        FROM emails e LEFT JOIN tail t ON t.email_id = e.id""",
    "extract_replies": """SELECT id, campaign_id, lead_id, email_id AS original_email_id, thread_id AS agentmail_thread_id,
        message_id AS agentmail_message_id, sender AS "from", subject, text, received_at, arrived_at FROM called_replies""",
    "event_counters_from_calls": f"""
        {_SEEDED}
        SELECT campaign_id, CAST(sum(delivered) AS BIGINT) AS emails_delivered, CAST(sum(bounced) AS BIGINT) AS emails_bounced,
          CAST(sum(clicked) AS BIGINT) AS emails_clicked, CAST(sum(replied) AS BIGINT) AS emails_replied FROM (
          SELECT campaign_id, (kind = 'provider' AND applied AND status = 'delivered')::INT AS delivered,
            (kind = 'provider' AND applied AND status = 'bounced')::INT AS bounced, 0 AS clicked, (kind = 'reply')::INT AS replied
          FROM judged WHERE kind <> 'click'
          UNION ALL SELECT campaign_id, 0, 0, 1, 0 FROM clicks) GROUP BY campaign_id""",
    "campaign_summary": "SELECT * FROM summary ORDER BY created_at DESC NULLS LAST, id LIMIT 50",
    "outreach_totals": """SELECT count(*) AS campaigns, CAST(coalesce(sum(leads_imported), 0) AS BIGINT) AS leads,
        CAST(sum(emails_sent) AS BIGINT) AS sent, CAST(sum(emails_delivered) AS BIGINT) AS delivered,
        CAST(sum(emails_bounced) AS BIGINT) AS bounced, CAST(sum(emails_clicked) AS BIGINT) AS clicked,
        CAST(sum(emails_replied) AS BIGINT) AS replied FROM summary""",
    "funnel_rates": "SELECT *, " + ", ".join(
        f"CASE WHEN emails_sent <> 0 THEN CAST(floor({c} / emails_sent * 100 + 0.5) AS BIGINT) END AS {name}"
        for c, name in (("emails_delivered", "delivery_rate"), ("emails_clicked", "click_rate"),
                        ("emails_replied", "reply_rate"), ("emails_bounced", "bounce_rate"))
    ) + ", emails_bounced / greatest(1, emails_sent) >= 0.05 AS unhealthy FROM counted",
    "campaign_counters": """
        SELECT campaign_id, coalesce(leads, 0) AS leads, coalesce(with_email, 0) AS leads_with_email, coalesce(drafts, 0) AS drafts,
          coalesce(sent, 0) AS sent, coalesce(delivered, 0) AS delivered, coalesce(bounced, 0) AS bounced,
          coalesce(clicked, 0) AS clicked, coalesce(replied, 0) AS replied
        FROM (SELECT campaign_id, count(*) AS leads, count(*) FILTER (email <> '') AS with_email FROM leads GROUP BY campaign_id)
        FULL JOIN (SELECT campaign_id, count(*) FILTER (status = 'drafted') AS drafts, count(*) FILTER (status IS DISTINCT FROM 'drafted') AS sent,
          count(*) FILTER (status IN ('delivered', 'clicked', 'replied')) AS delivered,
          count(*) FILTER (status IN ('bounced', 'complained', 'failed')) AS bounced,
          count(*) FILTER (coalesce(status, '') IN ('clicked', 'replied') OR click_count > 0) AS clicked,
          count(*) FILTER (status = 'replied') AS replied FROM clicked_emails GROUP BY campaign_id) USING (campaign_id)""",
    "step_stats": """
        SELECT g.campaign_id, g.step, coalesce(s.drafted, 0) AS drafted, coalesce(s.sent, 0) AS sent,
          coalesce(s.delivered, 0) AS delivered, coalesce(s.clicked, 0) AS clicked, coalesce(s.replied, 0) AS replied,
          f.framework, g.last > 1 AS is_sequence
        FROM grid g LEFT JOIN steps s USING (campaign_id, step)
        LEFT JOIN (SELECT campaign_id, coalesce(sequence_position, 1) AS step, framework FROM emails
          QUALIFY row_number() OVER (PARTITION BY campaign_id, coalesce(sequence_position, 1) ORDER BY created_at DESC, id DESC) = 1) f
          USING (campaign_id, step)""",
    "step_gate": """
        SELECT campaign_id, step, drafted, sent, drafted > 0 AND (step = 1 OR coalesce(before, 0) > 0) AS sendable
        FROM (SELECT campaign_id, step, coalesce(drafted, 0) AS drafted, coalesce(sent, 0) AS sent,
          lag(coalesce(sent, 0)) OVER (PARTITION BY campaign_id ORDER BY step) AS before FROM grid LEFT JOIN steps USING (campaign_id, step))""",
    "counter_drift": """
        WITH plain AS (SELECT campaign_id, count(*) FILTER (status <> '' AND status <> 'drafted') AS sent,
          count(*) FILTER (status IN ('delivered', 'clicked', 'replied')) AS delivered,
          count(*) FILTER (status IN ('bounced', 'complained', 'failed')) AS bounced,
          count(*) FILTER (status IN ('clicked', 'replied')) AS clicked, count(*) FILTER (status = 'replied') AS replied FROM emails GROUP BY campaign_id)
        SELECT c.id, """ + ", ".join(
        f"coalesce(c.emails_{n}, 0) AS cached_{n}, coalesce(p.{n}, 0) AS derived_{n},"
        f" coalesce(c.emails_{n}, 0) - coalesce(p.{n}, 0) AS drift_{n}"
        for n in ("sent", "delivered", "bounced", "clicked", "replied")
    ) + " FROM campaigns c LEFT JOIN plain p ON p.campaign_id = c.id",
    "flywheel_totals": """SELECT CAST(coalesce((SELECT count(*) FROM leads), 0) AS BIGINT) AS leads, CAST(sum(emails_sent) AS BIGINT) AS emails,
        CAST(sum(emails_clicked) AS BIGINT) AS clicks, CAST(sum(emails_replied) AS BIGINT) AS replies FROM summary""",
    "campaign_card": """SELECT c.name, c.status, c.query, coalesce(l.n, 0) AS leads_imported, s.emails_sent, s.emails_delivered, s.emails_clicked,
        s.emails_replied, coalesce(c.default_framework, 'one-off') AS framework, c.created_at
        FROM campaigns c JOIN summary s ON s.id = c.id
        LEFT JOIN (SELECT campaign_id, count(*) AS n FROM leads GROUP BY campaign_id) l ON l.campaign_id = c.id""",
    "plan_sequence": "SELECT * FROM planned",
    "plan_summary": """
        SELECT l.campaign_id, coalesce(p.n, 0) AS planned, l.ok * 3 - coalesce(p.n, 0) AS skipped_already_drafted,
          l.bad AS skipped_no_email, l.bad_site AS skipped_with_website
        FROM (SELECT campaign_id, count(*) FILTER (coalesce(email, '') <> '') AS ok, count(*) FILTER (coalesce(email, '') = '') AS bad,
          count(*) FILTER (coalesce(email, '') = '' AND website IS NOT NULL) AS bad_site FROM leads GROUP BY campaign_id) l
        LEFT JOIN (SELECT campaign_id, count(*) AS n FROM planned GROUP BY campaign_id) p USING (campaign_id)""",
    "draft_work_order": "SELECT * FROM planned ORDER BY step, lead_id, campaign_id",
    "draft_context": """
        SELECT p.campaign_id, p.lead_id, p.step, 'context' AS part, 0 AS part_step, CAST(NULL AS TIMESTAMP) AS part_at,
          CAST(NULL AS VARCHAR) AS part_id,
          'RECIPIENT' || chr(10) || concat_ws(chr(10), 'Business: ' || l.name,
            CASE WHEN l.company <> l.name THEN 'Company: ' || l.company END, 'Category: ' || l.category,
            'Location: ' || l.address, 'Website: ' || l.website, 'Notes: ' || l.notes)
          || chr(10) || chr(10) || 'SENDER' || chr(10) || 'Sender name: Ann' || chr(10) || 'Offer / value: a site audit' || chr(10)
          || 'ICP context: ' || c.query || chr(10) || chr(10) || 'FRAMEWORK: pas' || chr(10) || 'STEP: ' || p.step || ' of 3' AS text
        FROM planned p JOIN leads l ON l.id = p.lead_id JOIN campaigns c ON c.id = p.campaign_id
        UNION ALL
        SELECT p.campaign_id, p.lead_id, p.step, 'previous', coalesce(e.sequence_position, 1), e.created_at, e.id,
          '--- STEP ' || coalesce(e.sequence_position, 1) || ' ---' || chr(10) || 'Subject: ' || e.subject || chr(10) || chr(10) || e.body_text
        FROM planned p JOIN emails e ON e.campaign_id = p.campaign_id AND e.lead_id = p.lead_id AND coalesce(e.sequence_position, 1) < p.step
        UNION ALL
        SELECT DISTINCT p.campaign_id, p.lead_id, p.step, 'heading', 0, CAST(NULL AS TIMESTAMP), '',
          'PREVIOUS STEPS (for continuity — reference implicitly, never copy):'
        FROM planned p JOIN emails e ON e.campaign_id = p.campaign_id AND e.lead_id = p.lead_id AND coalesce(e.sequence_position, 1) < p.step""",
    "draft_context_one_off": """
        SELECT p.campaign_id, p.lead_id, p.step, 'context' AS part, 0 AS part_step, CAST(NULL AS TIMESTAMP) AS part_at,
          CAST(NULL AS VARCHAR) AS part_id,
          'RECIPIENT' || chr(10) || concat_ws(chr(10), 'Business: ' || l.name,
            CASE WHEN l.company <> l.name THEN 'Company: ' || l.company END, 'Category: ' || l.category,
            'Location: ' || l.address, 'Website: ' || l.website, 'Notes: ' || l.notes)
          || chr(10) || chr(10) || 'SENDER' || chr(10) || 'ICP context: ' || c.query AS text
        FROM planned p JOIN leads l ON l.id = p.lead_id JOIN campaigns c ON c.id = p.campaign_id""",
    "dedupe_new_drafts": """
        SELECT n.id, NOT (row_number() OVER (PARTITION BY campaign_id, lead_id, coalesce(sequence_position, 1) ORDER BY created_at, id) = 1
          AND NOT EXISTS (SELECT 1 FROM emails o WHERE o.status IS DISTINCT FROM 'drafted' AND o.campaign_id = n.campaign_id
            AND o.lead_id = n.lead_id AND coalesce(o.sequence_position, 1) = coalesce(n.sequence_position, 1))) AS skipped
        FROM emails n WHERE status = 'drafted'""",
    "select_sendable": """SELECT id, campaign_id, lead_id FROM emails e WHERE status = 'drafted' AND coalesce(sequence_position, 1) = 2
        AND NOT EXISTS (SELECT 1 FROM emails r WHERE r.status = 'replied' AND r.campaign_id = e.campaign_id AND r.lead_id = e.lead_id)""",
    "select_sendable_by_ids": """SELECT id, campaign_id, lead_id FROM emails WHERE status = 'drafted'
        AND id IN (SELECT email_id FROM clicks)""",
    "outbound_messages": "SELECT id, to_email, subject, "
        + _rewritten("body", "campaign_id", "lead_id", "id")
        + " AS html FROM (SELECT *, CASE WHEN coalesce(body_html, '') <> '' THEN body_html ELSE '<p>' || body_text || '</p>' END AS body"
          " FROM emails WHERE status = 'drafted')",
    "default_bodies": """SELECT id, CASE WHEN body_html <> '' THEN body_html
        ELSE '<p>' || replace(body_text, chr(10), '</p><p>') || '</p>' END AS body_html FROM emails""",
    "normalize_drafts": f"""
        SELECT doc_id, doc_id % 4 <> 1 AS ok,
          CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 5 = 0 THEN 'Quick question' ELSE source || ' ' || doc_id END AS subject,
          CASE WHEN doc_id % 4 <> 1 THEN {_trim("text")} END AS body_text,
          CASE WHEN doc_id % 4 <> 1 THEN '' END AS body_html FROM documents""",
    "send_report": """
        SELECT campaign_id, count(*) FILTER (ok) AS sent, count(*) AS total, count(*) FILTER (NOT ok) AS errors,
          CASE WHEN count(*) FILTER (ok) > 0 THEN 'completed' ELSE 'failed' END AS status
        FROM (SELECT campaign_id, CAST(campaign_id AS INTEGER) % 5 <> 0 AND CAST(id AS BIGINT) % 10 <> 0 AS ok
          FROM emails WHERE status = 'drafted') GROUP BY campaign_id""",
    "map_run_status": """
        WITH r AS (SELECT *, o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 AS live,
          o_orderpriority = '1-URGENT' AS done, o_orderpriority IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AS broken,
          o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 AS no_data FROM orders)
        SELECT CAST(o_orderkey AS VARCHAR) AS campaign_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'run' || o_orderkey END AS run_id,
          CASE WHEN o_orderkey % 4 = 0 THEN 'draft' WHEN NOT live THEN 'searching' WHEN broken OR (done AND no_data) THEN 'failed'
            WHEN done THEN 'ready' ELSE 'searching' END AS status,
          CASE WHEN NOT live THEN NULL WHEN done AND no_data THEN 'Apify succeeded but no dataset id was returned'
            WHEN broken THEN 'Apify run ' || CASE o_orderpriority WHEN '2-HIGH' THEN 'failed' WHEN '3-MEDIUM' THEN 'aborted' ELSE 'timed-out' END
              || ': ' || CASE WHEN o_orderstatus = 'P' THEN 'msg ' || o_custkey ELSE 'no details' END END AS error_message,
          live AND (done OR broken) AS changed FROM r""",
    "newest_first": "SELECT id, campaign_id, created_at FROM emails ORDER BY created_at DESC NULLS LAST, id LIMIT 500",
    "newest_per_group": """SELECT id, campaign_id, created_at FROM emails
        QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY created_at DESC NULLS LAST, id) <= 5""",
    "activity_feed": f"""
        SELECT id, agent_id, category, summary, details, created_at FROM activity
        UNION ALL {_WEBHOOK_FEED}
        UNION ALL SELECT 'reply-' || id, NULL, 'email', 'Reply from ' || coalesce(sender, 'unknown') || ': '
            || substring(coalesce(subject, '(no subject)'), 1, 80),
          '{{"reply_id":"' || id || '"' || CASE WHEN campaign_id IS NULL THEN ',"campaign_id":null' ELSE ',"campaign_id":"' || campaign_id || '"' END || '}}',
          received_at FROM matched_replies
        UNION ALL {_CLICK_FEED}
        UNION ALL SELECT 'submission-' || id, NULL, 'system', 'Form "' || form_slug || '" received a submission',
          '{{"submission_id":"' || id || '","data":' || CASE WHEN e_mail IS NULL THEN '{{}}'
            ELSE '{{"k":"' || k || '","e_mail":"' || e_mail || '"}}' END || '}}', received_at FROM submissions
        UNION ALL SELECT 'task-' || id, assignee_id, 'task', 'Task created: "' || title || '"', NULL, created_at FROM tasks
        UNION ALL SELECT 'agent-' || id, id, 'system', 'Agent "' || name || '" registered as @' || sign_in_name, NULL, created_at FROM agents
        UNION ALL SELECT 'invitation-' || id, agent_id, 'decision', agent_name || ' wants to talk: ' || reason,
          '{{"invitation_id":"' || id || '"}}', created_at FROM invitations
        UNION ALL SELECT 'page-' || slug, NULL, 'content', 'Landing page "' || title || '" published at /p/' || slug,
          '{{"slug":"' || slug || '"' || CASE WHEN linked_form_slug IS NULL THEN '' ELSE ',"linked_form_slug":"' || linked_form_slug || '"' END || '}}',
          TIMESTAMP '2024-01-05 00:00:00' FROM site_pages
        UNION ALL SELECT 'campaign-' || id, NULL, 'content', 'Outreach campaign created: "' || name || '"',
          '{{"campaign_id":"' || id || '","query":"' || query || '"}}', created_at FROM campaigns
        UNION ALL SELECT 'lead-' || l.id, NULL, 'system', 'Test lead added to campaign "' || c.name || '": ' || l.email,
          '{{"campaign_id":"' || c.id || '","lead_id":"' || l.id || '"}}', l.created_at
          FROM leads l JOIN campaigns c ON c.id = l.campaign_id WHERE is_test
        UNION ALL SELECT 'draft-' || id, NULL, 'content', 'Agent drafted email (' || coalesce(framework, 'one-off') || ' step '
            || coalesce(sequence_position, 1) || '/3) for ' || to_name,
          '{{"campaign_id":"' || campaign_id || '","lead_id":"' || lead_id || '","email_id":"' || id || '","framework":"'
            || coalesce(framework, 'one-off') || '","step":' || coalesce(sequence_position, 1) || '}}', created_at
          FROM emails WHERE source = 'agent_drafted'""",
    "activity_feed_changes": """
        SELECT 'move-' || id AS id, assignee_id AS agent_id, 'task' AS category, 'Task "' || title || '" → ' || coalesce(status, 'todo') AS summary,
          CAST(NULL AS VARCHAR) AS details, created_at FROM tasks
        UNION ALL SELECT 'convert-' || id, NULL, 'decision', title || ' converted to task', '{"task_id":"' || id || '","reply_id":"r' || id || '"}', created_at FROM tasks
        UNION ALL SELECT 'agent-deleted-' || id, NULL, 'system', 'Agent ' || id || ' deleted', NULL, created_at FROM agents
        UNION ALL SELECT 'session-' || id, NULL, 'system', 'Voice session ' || id, '{"session_id":"' || id || '"}', ended_at FROM sessions
        UNION ALL SELECT 'page-update-' || slug, NULL, 'content', 'Landing page "' || CASE WHEN linked_form_slug IS NULL THEN slug ELSE title END
          || '" updated (' || CASE WHEN linked_form_slug IS NULL THEN 'no fields' ELSE 'title, theme' END || ')',
          '{"slug":"' || slug || '","changed":' || CASE WHEN linked_form_slug IS NULL THEN '[]' ELSE '["title","theme"]' END || '}',
          TIMESTAMP '2024-01-05 00:00:00' FROM site_pages
        UNION ALL SELECT 'scrape-start-' || id, NULL, 'research', 'Apify run started for "' || name || '"',
          '{"campaign_id":"' || id || '","apify_run_id":"run' || id || '"}', created_at FROM campaigns
        UNION ALL SELECT 'scrape-' || id, NULL, 'research', 'Apify scrape complete: ' || coalesce(leads_imported, 0) || ' leads imported for "' || name || '"',
          '{"campaign_id":"' || id || '","imported":' || coalesce(leads_imported, 0) || '}', created_at FROM campaigns
        UNION ALL SELECT 'drafts-' || id, NULL, 'content', 'Drafted ' || emails_clicked || ' emails for "' || name || '"',
          '{"campaign_id":"' || id || '","generated":' || emails_clicked || ',"errors":' || emails_bounced || '}', created_at FROM campaigns
        UNION ALL SELECT 'send-' || id, NULL, 'email', 'Sent ' || coalesce(emails_sent, 0) || ' of ' || emails_delivered || ' emails for "' || name || '"',
          '{"campaign_id":"' || id || '","sent":' || coalesce(emails_sent, 0) || ',"errors":' || emails_bounced || '}', created_at FROM campaigns""",
    "new_entries": """SELECT id, agent_id, category, summary, details, created_at FROM (SELECT * FROM activity ORDER BY created_at DESC, id LIMIT 1)
        WHERE id NOT IN (SELECT id FROM activity WHERE created_at < (SELECT max(created_at) FROM activity) - INTERVAL 1 DAY ORDER BY created_at DESC, id LIMIT 5)""",
    "feed_active": """SELECT max(created_at) AS newest_at, coalesce(TIMESTAMP '2024-01-05 00:00:00' - max(created_at) < INTERVAL 60 SECOND, false) AS active FROM activity""",
    "inbox": """SELECT sender AS "from", subject, substring(coalesce(text, ''), 1, 280) AS preview, received_at, campaign_id FROM matched_replies""",
    "tabulate_form": """SELECT received_at, nullif(k, '') AS "Key", nullif(e_mail, '') AS "E-Mail", id FROM submissions WHERE form_slug = 'form-3'""",
    "agent_directory": """
        SELECT id, substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 32) || '-' || substring(id, 1, 4) AS sign_in_name,
          CASE WHEN last_heartbeat IS NULL THEN 'never' ELSE '5h ago' END AS seen,
          'key-' || repeat('•', length(name) - 4) || right(name, 4) AS secret, repeat('•', length(id)) AS short_secret,
          repeat('•', length(name)) || right(name, 4) AS listed FROM agents""",
    "publish_pages": """SELECT * FROM (SELECT page_id, nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug
        FROM pages) WHERE slug IS NOT NULL""",
    "event_properties": "SELECT event_id, nullif(json_extract_string(props, '$.k'), '') AS k FROM events",
    "send_report_of_runs": """
        SELECT c.id AS campaign_id, coalesce(s.sent, 0) AS sent, coalesce(s.total, 0) AS total, coalesce(s.errors, 0) AS errors,
          CASE WHEN coalesce(s.sent, 0) > 0 THEN 'completed' ELSE 'failed' END AS status FROM campaigns c LEFT JOIN (
          SELECT campaign_id, count(*) FILTER (ok) AS sent, count(*) AS total, count(*) FILTER (NOT ok) AS errors
          FROM (SELECT campaign_id, CAST(campaign_id AS INTEGER) % 5 <> 0 AND CAST(id AS BIGINT) % 10 <> 0 AS ok
            FROM emails WHERE status = 'drafted') GROUP BY campaign_id) s ON s.campaign_id = c.id""",
    "normalize_steps": """
        WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'pas' WHEN 1 THEN 'aida' ELSE 'one-off' END AS framework,
          CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 9 - 1.5 END AS s, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 + 0.5 END AS t FROM orders)
        SELECT id, framework, CAST(CASE WHEN s BETWEEN 1 AND 5 THEN floor(s) ELSE 1 END AS INTEGER) AS step,
          CAST(CASE WHEN t BETWEEN 1 AND 5 THEN floor(t) WHEN framework = 'one-off' THEN 1 ELSE 3 END AS INTEGER) AS total_steps, 'model' AS "by" FROM d
        UNION ALL SELECT id, framework, CAST(CASE WHEN s >= 1 THEN floor(s) ELSE 1 END AS INTEGER),
          CAST(CASE WHEN t >= 1 THEN floor(t) WHEN s >= 1 THEN floor(s) ELSE 1 END AS INTEGER), 'agent' FROM d""",
    "outbound_headers": """
        SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN to_name ELSE split_part(to_email, '@', 1) END AS to_name, split_part(to_email, '@', 1) AS mailbox,
          replace(replace(replace(replace(replace(body_html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM emails""",
    "dedupe_feed": """SELECT DISTINCT id, agent_id, category, summary, details, created_at FROM activity
        ORDER BY created_at DESC, id LIMIT 20""",
    "route_activity": """SELECT id, CASE n % 8 WHEN 0 THEN '/outreach/' || user_id WHEN 1 THEN '/inbox'
        WHEN 2 THEN CASE WHEN category = 'content' THEN CASE WHEN n % 3 = 0 THEN '/pages' ELSE '/forms/s' || user_id END END
        WHEN 3 THEN '/tasks' WHEN 4 THEN '/voice' WHEN 5 THEN '/voice' END AS route,
        CASE WHEN category = 'mystery' THEN 'system' ELSE category END AS shown_as FROM activity""",
    "activity_with_agent": "SELECT a.id, a.agent_id, coalesce(g.emoji, '⚡') AS emoji FROM activity a LEFT JOIN agents g ON g.id = a.agent_id",
    "kanban_counts": """SELECT position, status, coalesce(n, 0) AS tasks FROM (VALUES (0, 'todo'), (1, 'doing'), (2, 'needs_input'),
        (3, 'canceled'), (4, 'done')) c(position, status) LEFT JOIN (SELECT status, count(*) AS n FROM tasks GROUP BY status) USING (status)""",
    "office_stats": """SELECT (SELECT count(*) FROM agents WHERE status = 'online') AS active_agents,
        (SELECT count(*) FROM tasks WHERE status = 'doing') AS tasks_in_progress,
        (SELECT least(20, count(*)) FROM activity) AS activity_shown""",
    "replies_to_tasks": """SELECT 'task-' || id AS id, 'Reply from ' || coalesce(sender, 'unknown') AS title,
        coalesce(subject, '(no subject)') || chr(10) || chr(10) || substring(text, 1, 200) || chr(10) || chr(10) || 'Campaign: '
          || coalesce(campaign_id, '—') AS description,
        'needs_input' AS status, 'medium' AS priority, 'outreach_reply' AS source, id AS reply_id FROM matched_replies""",
    "webhook_counts": """SELECT w.id, w.name, count(c.id) AS events, count(c.id) > 0 AS is_live
        FROM webhooks w LEFT JOIN calls c ON c.webhook_id = w.id GROUP BY w.id, w.name""",
    "submission_counts": """SELECT f.slug, f.title, count(s.id) AS submissions
        FROM forms f LEFT JOIN submissions s ON s.form_slug = f.slug GROUP BY f.slug, f.title""",
    "normalize_form_fields": "SELECT * EXCLUDE (n) FROM form_fields",
    "tabulate_submissions": """SELECT s.form_slug, s.id AS submission_id, s.received_at, f.position, f.label,
        nullif(CASE f.name WHEN 'k' THEN s.k WHEN 'e_mail' THEN s.e_mail END, '') AS value
        FROM submissions s JOIN form_fields f ON f.slug = s.form_slug""",
    "classify_pages": """SELECT slug, CASE WHEN page_id % 4 = 2 THEN false
        ELSE regexp_matches(lower(html), '^[\\s]*<(!doctype|html)') END AS full_html FROM site_pages""",
    "link_pages_forms": """SELECT DISTINCT p.slug AS page_slug, f.slug AS form_slug FROM site_pages p JOIN forms f
        ON f.slug IN (p.linked_form_slug, CASE WHEN page_id % 4 = 0 THEN 'form-' || page_id END, CASE WHEN page_id % 4 = 0 THEN 'form-' || page_id * 9 END)""",
    "resolve_page_form": """SELECT p.slug AS page_slug, wanted AS wanted_form, f.title AS form_title, f.title IS NOT NULL AS shows_form
        FROM (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'form-' || page_id * 9 ELSE linked_form_slug END AS wanted FROM site_pages) p
        LEFT JOIN forms f ON f.slug = p.wanted""",
    "rewrite_links": f"SELECT page_id, {_rewritten('html', repr('c1'), repr('l1'), 'CAST(page_id AS VARCHAR)')} AS html FROM pages",
    "latest_snapshot": """
        WITH ch AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderdate AS "at", o_orderkey AS seq,
          CASE WHEN o_orderkey % 10 = 9 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'put' ELSE 'patch' END AS op,
          CASE WHEN o_orderkey % 4 <> 0 THEN 'title ' || o_orderkey END AS title,
          CASE WHEN o_orderkey % 5 < 2 THEN o_orderpriority END AS priority FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at", seq) AS rn FROM ch),
        base AS (SELECT id, max(rn) FILTER (op = 'put') AS put, max(rn) FILTER (op = 'delete') AS gone FROM n GROUP BY id),
        live AS (SELECT n.*, base.put FROM n JOIN base USING (id) WHERE put > coalesce(gone, 0) AND (rn = put OR (rn > put AND op = 'patch')))
        SELECT id, coalesce(arg_max(title, rn) FILTER (title IS NOT NULL AND rn > put), max(title) FILTER (rn = put)) AS title,
          coalesce(arg_max(priority, rn) FILTER (priority IS NOT NULL AND rn > put), max(priority) FILTER (rn = put)) AS priority,
          arg_max("at", rn) AS "at", arg_max(seq, rn) AS seq FROM live GROUP BY id""",
    "agent_presence": """SELECT a.id, a.name, a.sign_in_name, a.emoji, a.created_at,
        CASE WHEN b.beat IS NOT NULL THEN 'online' ELSE a.status END AS status, greatest(b.beat, a.last_heartbeat) AS last_heartbeat
        FROM agents a LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS beat FROM events GROUP BY 1) b USING (id)""",
    "fold_transcript": "SELECT * FROM transcript",
    "merge_tool_calls": "SELECT * FROM merged_calls",
    "session_summary": """
        SELECT id, started_at, seconds AS duration_seconds,
          CASE WHEN seconds >= 60 THEN seconds // 60 || 'm ' ELSE '' END || seconds % 60 || 's' AS duration,
          coalesce(turns, 0) AS turns, coalesce(tool_calls, 0) AS tool_calls, first_user_text,
          'Voice session (' || seconds || 's): ' || coalesce(substring(first_user_text, 1, 80), 'no user input') AS summary
        FROM (SELECT *, CAST(floor(date_diff('millisecond', started_at, ended_at) / 1000 + 0.5) AS BIGINT) AS seconds FROM sessions)
        LEFT JOIN (SELECT session_id AS id, count(*) AS turns, arg_min(text, seq) FILTER (role = 'user') AS first_user_text
          FROM transcript GROUP BY session_id) USING (id)
        LEFT JOIN (SELECT session_id AS id, count(*) AS tool_calls FROM merged_calls GROUP BY session_id) USING (id)""",
    "session_invitations": """SELECT s.id AS session_id, s.invitation_id, i.agent_name, i.reason, i.status AS status_before,
        CASE WHEN i.id IS NOT NULL THEN 'accepted' END AS status_after, CASE WHEN i.id IS NOT NULL THEN s.ended_at END AS accepted_at
        FROM sessions s LEFT JOIN invitations i ON i.id = s.invitation_id""",
    "pending_invitations": "SELECT * FROM invitations WHERE status = 'pending' ORDER BY created_at DESC, id",
    "stream_activity_feed": f"""{_WEBHOOK_FEED} UNION ALL
        SELECT * FROM ({_CLICK_FEED}) WHERE id NOT LIKE '%-1' AND id NOT LIKE '%-2' AND id NOT LIKE '%-3'""",
    "stream_status_from_calls": """
        WITH p AS (SELECT *, CASE status WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'replied' THEN 4 ELSE 0 END AS rnk,
          sum(CASE WHEN status IN ('bounced', 'complained', 'failed') THEN 1 ELSE 0 END)
            OVER (PARTITION BY email_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS seg FROM matched_log
          WHERE kind = 'provider' OR starts_with(event_id, 'reply-'))
        SELECT email_id, CASE max(rnk) FILTER (seg = last_seg) WHEN 1 THEN 'sent' WHEN 2 THEN 'delivered' WHEN 4 THEN 'replied'
          ELSE max(status) FILTER (seg = last_seg) END AS status, count(*) AS events
        FROM (SELECT *, max(seg) OVER (PARTITION BY email_id) AS last_seg FROM p) GROUP BY email_id""",
    "stream_clicks": """SELECT email_id, count(*) AS click_count, max(clicked_at) AS last_clicked_at FROM clicks
        WHERE line > 3 GROUP BY email_id""",
    "webhook_health": """
        WITH probes AS (SELECT CAST(event_id AS VARCHAR) AS probe_id, 'w' || user_id % 7 AS webhook_id,
          ts - to_seconds(event_id % 20) AS since FROM events)
        SELECT p.probe_id, p.webhook_id, count(c.id) AS new_events, count(c.id) > 0 AS ok
        FROM probes p LEFT JOIN calls c ON c.webhook_id = p.webhook_id AND c.received_at >= p.since
          AND c.received_at < p.since + INTERVAL 15 SECOND GROUP BY p.probe_id, p.webhook_id""",
    "stream_dedupe_deliveries": """SELECT DISTINCT CASE WHEN event_type IS NOT NULL THEN provider_event_id END AS event_id,
        CASE WHEN event_type IS NULL THEN id END AS id FROM calls""",
}
_STATEMENTS["stored_round_trip"] = "SELECT id, '00' || campaign_id AS campaign_id, email_id, clicked_at FROM clicks WHERE campaign_id = '7'"
_STATEMENTS["newest_stored"] = """SELECT id, campaign_id, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS created_at FROM emails
    ORDER BY date_trunc('month', created_at) DESC NULLS LAST, id LIMIT 100"""
_STATEMENTS["lookup"] = "SELECT id, campaign_id, CAST(date_trunc('year', created_at) AS TIMESTAMP) AS created_at FROM emails WHERE id = '7'"
_STATEMENTS["stream_whole_feed"] = _STATEMENTS["activity_feed"]
_STATEMENTS["merged_snapshot"] = _STATEMENTS["latest_snapshot"]
_STATEMENTS["orphan_sweep"] = """
    WITH kept_leads AS (SELECT id FROM leads WHERE CAST(id AS BIGINT) % 10 <> 7),
    kept_campaigns AS (SELECT id FROM campaigns WHERE status <> 'draft'),
    l AS (SELECT id, campaign_id NOT IN (SELECT id FROM kept_campaigns) AS gone FROM leads WHERE id IN (SELECT id FROM kept_leads)),
    e AS (SELECT id, CASE WHEN campaign_id NOT IN (SELECT id FROM kept_campaigns) THEN 'campaigns'
      WHEN lead_id NOT IN (SELECT id FROM l WHERE NOT gone) THEN 'leads' END AS cause FROM emails),
    r AS (SELECT id, CASE WHEN campaign_id IS NOT NULL AND campaign_id NOT IN (SELECT id FROM kept_campaigns) THEN 'campaigns'
      WHEN email_id IS NOT NULL AND email_id NOT IN (SELECT id FROM e WHERE cause IS NULL) THEN 'emails' END AS cause FROM matched_replies)
    SELECT 'leads' AS kind, id, 'campaigns' AS cause FROM l WHERE gone
    UNION ALL SELECT 'emails', id, cause FROM e WHERE cause IS NOT NULL
    UNION ALL SELECT 'replies', id, cause FROM r WHERE cause IS NOT NULL
    UNION ALL SELECT 'clicks', id, 'emails' FROM clicks WHERE email_id NOT IN (SELECT id FROM e WHERE cause IS NULL)
    UNION ALL SELECT 'webhook_events', id, 'webhooks' FROM calls WHERE webhook_id NOT IN (SELECT id FROM webhooks)
    UNION ALL SELECT 'agent_keys', 'key-' || id, 'agents' FROM agents WHERE status = 'error'"""
_CHANGED = """
    {n}_n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at", seq) AS rn FROM {n}_log),
    {n}_m AS (SELECT *, max(CASE WHEN op = 'put' THEN rn END) OVER w AS p, max(CASE WHEN op = 'delete' THEN rn END) OVER w AS g FROM {n}_n
      WINDOW w AS (PARTITION BY id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {n}_met AS (SELECT m.id, m.rn, arg_max(x.title, x.rn) AS title{more} FROM {n}_m m JOIN {n}_n x ON x.id = m.id AND x.rn >= m.p AND x.rn < m.rn
      WHERE m.op = 'patch' AND m.p > coalesce(m.g, 0) GROUP BY m.id, m.rn)"""
_STATEMENTS["activity_feed_from_changes"] = f"""
    WITH t_log AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderdate AS "at", o_orderkey AS seq,
      CASE WHEN o_orderkey % 10 = 9 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'put' ELSE 'patch' END AS op,
      CASE WHEN o_orderkey % 4 <> 0 THEN 'Task ' || o_orderkey END AS title,
      CASE o_orderkey % 5 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing' WHEN 2 THEN 'done' END AS status,
      CASE WHEN o_orderkey % 2 = 0 THEN 'agent' || o_orderkey % 7 END AS assignee_id FROM orders),
    {_CHANGED.format(n='t', more=', arg_max(x.assignee_id, x.rn) AS assignee_id')},
    p_log AS (SELECT 'page-' || user_id AS id, ts AS "at", event_id AS seq, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op,
      CASE WHEN event_id % 4 <> 0 THEN 'Page ' || event_id END AS title, CASE WHEN event_id % 3 = 0 THEN 'dark' END AS theme FROM events),
    {_CHANGED.format(n='p', more='')}
    SELECT 'move-' || id || '-' || seq AS id, m.assignee_id AS agent_id, 'task' AS category, 'Task "' || m.title || '" → ' || status AS summary,
      CAST(NULL AS VARCHAR) AS details, "at" AS created_at FROM t_n JOIN (SELECT id AS mid, rn AS mrn, title, assignee_id FROM t_met) m ON mid = id AND mrn = rn WHERE status IS NOT NULL
    UNION ALL SELECT 'page-update-' || id || '-' || seq, NULL, 'content', 'Landing page "' || coalesce(m.title, id) || '" updated ('
        || CASE WHEN p_n.title IS NOT NULL AND theme IS NOT NULL THEN 'title, theme' WHEN p_n.title IS NOT NULL THEN 'title' WHEN theme IS NOT NULL THEN 'theme' ELSE 'no fields' END || ')',
      '{{"slug":"' || id || '","changed":[' || CASE WHEN p_n.title IS NOT NULL AND theme IS NOT NULL THEN '"title","theme"' WHEN p_n.title IS NOT NULL THEN '"title"' WHEN theme IS NOT NULL THEN '"theme"' ELSE '' END || ']}}',
      "at" FROM p_n JOIN (SELECT id AS mid, rn AS mrn, title FROM p_met) m ON mid = id AND mrn = rn
    UNION ALL SELECT 'agent-deleted-' || o_custkey, NULL, 'system', 'Agent ' || o_custkey || ' deleted', NULL, o_orderdate FROM orders WHERE o_orderkey % 10 = 9"""
_STATEMENTS["stream_live_feed"] = f"""
    WITH live AS (SELECT id, agent_id, category, summary, details, created_at FROM activity UNION ALL {_WEBHOOK_FEED}
      UNION ALL SELECT * FROM ({_CLICK_FEED}) WHERE id NOT LIKE '%-1' AND id NOT LIKE '%-2' AND id NOT LIKE '%-3'
      UNION ALL SELECT 'submission-' || id, NULL, 'system', 'Form "' || form_slug || '" received a submission',
          '{{"submission_id":"' || id || '","data":' || CASE WHEN e_mail IS NULL THEN '{{}}'
            ELSE '{{"k":"' || k || '","e_mail":"' || e_mail || '"}}' END || '}}', received_at FROM submissions),
    top AS (SELECT *, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INTEGER) AS position FROM live)
    SELECT *, CASE WHEN position = 1 THEN true END AS flashed,
      CASE WHEN position = 1 THEN TIMESTAMP '2024-01-05 00:00:00' - created_at < INTERVAL 60 SECOND END AS active FROM top WHERE position <= 20"""
_STATEMENTS["stream_email_status"] = _STATEMENTS["fold_email_status"]
_STATEMENTS["stream_applied_events"] = _STATEMENTS["applied_events"]
_STATEMENTS["stream_campaign_counters"] = _STATEMENTS["event_counters"]


def _needed(sql: str, seen: list[str]) -> list[str]:
    """Names of the views a statement uses, each after the ones it builds on."""
    for name, body in VIEWS.items():
        if name not in seen and re.search(rf"\b(?:FROM|JOIN) \(?{name}\b|, {name}\b(?= WHERE)", sql):
            _needed(body, seen)
            seen.append(name)
    return seen


def _with_views(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql
    views = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


ORACLE_SQL = {name: _with_views(sql) for name, sql in _STATEMENTS.items()}
