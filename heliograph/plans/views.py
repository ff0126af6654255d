"""Domain tables derived from the driver's tables, whole tables throughout.

Only these views know the driver's schema; the operators see the stored entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.tokens import encode_click_token
from heliograph.operators.correlation import with_click_stats
from heliograph.operators.funnel import email_counters
from heliograph.operators.leads import lead_count

BASE_URL = "https://track.test"


# The driver's tables. With the schemas given, no file is opened before a query runs.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def _rows(spark: SparkSession, sf: str, name: str, given: DataFrame | None) -> DataFrame:
    """A driver table, or what is given in its place: a stream of it."""
    return table(spark, sf, name) if given is None else given


def stream(spark: SparkSession, sf: str, name: str, max_bytes: int) -> DataFrame:
    """A driver table as a file stream that admits so many bytes per micro-batch.

    The path is a pattern because a stream takes a plain path for a folder, and a table may be one file.
    """
    reader = spark.readStream.schema(TABLES[name]).option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(f"{sf}/{name}[.]parquet")


def campaigns(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    return _rows(spark, sf, "nation", given).selectExpr(
        "CAST(n_nationkey AS STRING) AS id",
        "n_name AS name",
        "concat('find ', lower(n_name)) AS query",
        "CASE n_nationkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'searching' ELSE 'ready' END AS status",
        "named_struct('location', n_name, 'searchTerms', array(lower(n_name)),"
        " 'maxResults', CAST(10 + n_nationkey * 2 AS INT)) AS structured_query",
        "CASE WHEN n_nationkey % 6 <> 0 THEN CAST(n_nationkey * 10 AS BIGINT) END AS leads_imported",
        "CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 100 AS BIGINT) END AS emails_sent",
        "CAST(n_nationkey * 60 AS BIGINT) AS emails_delivered",
        "CAST(n_nationkey * 7 AS BIGINT) AS emails_bounced",
        "CAST(n_nationkey * 30 AS BIGINT) AS emails_clicked",
        "CAST(n_nationkey * 11 AS BIGINT) AS emails_replied",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'pas' END AS default_framework",
        "CAST(timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, n_nationkey) AS TIMESTAMP) AS created_at",
    )


def counted_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """Campaigns whose cached counters are those of their leads and e-mails."""
    counted = email_counters(emails_with_clicks(spark, sf)).withColumnRenamed("campaign_id", "id")
    people = lead_count(leads(spark, sf)).selectExpr("campaign_id AS id", "leads AS leads_imported")
    cached = [c for c in (*counted.columns, "leads_imported") if c != "id"]
    return campaigns(spark, sf).drop(*cached).join(counted, "id", "left").join(people, "id", "left")


def leads(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    return _rows(spark, sf, "customer", given).selectExpr(
        "CAST(c_custkey AS STRING) AS id",
        "CAST(c_nationkey AS STRING) AS campaign_id",
        "c_name AS name",
        "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN concat('Co ', c_name) END AS company",
        "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''"
        " ELSE concat(replace(lower(c_name), '#', '.'), '@example.org') END AS email",
        "CASE WHEN c_custkey % 3 <> 0 THEN concat('https://SRC', c_custkey % 25, '/home') END AS website",
        "concat('City ', c_nationkey) AS address",
        "c_mktsegment AS category",
        "CASE WHEN c_custkey % 4 = 0 THEN concat('note ', c_custkey) END AS notes",
        "c_custkey % 97 = 0 AS is_test",
        "CAST(timestamp_ntz'2024-02-01 00:00:00' AS TIMESTAMP) AS created_at",
    )


# Statuses by order status and priority; the last two of F are a missing and an empty status.
_STATUS = """CASE o_orderstatus
    WHEN 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'replied' WHEN '2-HIGH' THEN 'clicked'
        WHEN '3-MEDIUM' THEN 'delivered' WHEN '4-NOT SPECIFIED' THEN 'sent' ELSE 'drafted' END
    WHEN 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'bounced' WHEN '2-HIGH' THEN 'complained'
        WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'delivered' ELSE 'drafted' END
    ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'replied' WHEN '2-HIGH' THEN 'clicked'
        WHEN '3-MEDIUM' THEN 'sent' WHEN '4-NOT SPECIFIED' THEN NULL ELSE '' END END AS status"""


def emails(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """E-mails without click counters."""
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    return _rows(spark, sf, "orders", given).join(people, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "CAST(o_orderkey AS STRING) AS id",
        "CAST(c_nationkey AS STRING) AS campaign_id",
        "CAST(o_custkey AS STRING) AS lead_id",
        "concat(replace(lower(c_name), '#', '.'), '@example.org') AS to_email",
        "c_name AS to_name",
        "concat('Offer ', o_orderkey) AS subject",
        "concat('Hello ', c_name, '\\nPriority ', o_orderpriority) AS body_text",
        "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<p><a HREF=\"https://shop.test/?o=', o_orderkey,"
        " '\">go</a> <a href=\"mailto:a@b.test\">m</a></p>') END AS body_html",
        "CASE o_orderkey % 4 WHEN 0 THEN 'pas' WHEN 1 THEN 'aida' WHEN 2 THEN 'sdr' END AS framework",
        "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 3 + 1 AS INT) END AS sequence_position",
        "CAST(3 AS INT) AS sequence_total",
        "CASE WHEN o_orderkey % 50 = 0 THEN 'agent_drafted' END AS source",
        _STATUS,
        "CAST(NULL AS BIGINT) AS click_count",
        "concat('m', o_orderkey) AS agentmail_message_id",
        "concat('t', o_custkey) AS agentmail_thread_id",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    )


def clicks(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Tracked clicks; the campaign is right for some and wrong for most."""
    return _rows(spark, sf, "lineitem", given).selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS id",
        "CAST(l_suppkey % 25 AS STRING) AS campaign_id",
        "CAST(l_partkey AS STRING) AS lead_id",
        "CAST(l_orderkey AS STRING) AS email_id",
        "concat('https://shop.test/p/', l_partkey) AS url",
        "CAST(l_shipdate AS TIMESTAMP) AS clicked_at",
    )


def emails_with_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return with_click_stats(emails(spark, sf), clicks(spark, sf))


def click_tokens(lineitem: DataFrame) -> DataFrame:
    """Tokens of all items: a seventh is garbage, others lack the address or the e-mail or hold a
    character that doesn't belong there."""
    line = F.col("l_linenumber")
    email = F.when(line != 3, F.col("l_orderkey").cast("string"))
    url = F.when(line != 2, F.concat(F.lit("https://shop.test/p/"), F.col("l_partkey").cast("string")))
    token = encode_click_token(F.col("l_suppkey") % 25, F.col("l_partkey"), email, url)
    return lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("id"),
        F.when(line == 1, F.concat(F.lit("x"), token)).when(line == 4, F.concat(F.lit("!"), token)).otherwise(token).alias("token"),
        F.col("l_shipdate").cast("timestamp").alias("clicked_at"),
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """Lifecycle events of e-mails; every third `signup` acknowledges a send."""
    return events.selectExpr(
        "CAST(user_id AS STRING) AS email_id",
        "CAST(ts AS TIMESTAMP) AS at",
        "CAST(event_id AS STRING) AS event_id",
        "CASE event_type WHEN 'signup' THEN 'sent' WHEN 'view' THEN 'delivered' WHEN 'click' THEN 'clicked'"
        " WHEN 'purchase' THEN 'replied' ELSE 'bounced' END AS status",
        "CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'ack' WHEN event_type = 'click' THEN 'click'"
        " WHEN event_type = 'purchase' THEN 'reply' ELSE 'provider' END AS kind",
    )


def lifecycle_with_campaign(events: DataFrame) -> DataFrame:
    return lifecycle(events).withColumn(
        "campaign_id", (F.col("email_id").cast("bigint") % 25).cast("string")
    )


def provider_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with provider ids; every fourth has no message id, every twentieth has none at all."""
    return table(spark, sf, "events").selectExpr(
        "CAST(event_id AS STRING) AS id",
        "CASE WHEN event_id % 4 <> 0 THEN concat('m', event_id) END AS message_id",
        "CASE WHEN event_id % 20 <> 0 THEN concat('t', user_id) END AS thread_id",
        "CAST(ts AS TIMESTAMP) AS received_at",
    )


def raw_webhook_calls(events: DataFrame) -> DataFrame:
    """Requests as they come in: provider calls, other JSON, and every tenth no JSON at all."""
    ids = (
        "concat('{\"message_id\":\"m', event_id, '\",\"thread_id\":\"t', user_id, '\"}')"
    )
    typed = "concat('{\"event_type\":\"', %s, '\",\"event_id\":\"', event_id %% 9000, '\",\"', %s, '\":', " + ids + ", '}')"
    error_type = (
        "CASE event_id % 3 WHEN 0 THEN 'message.bounced' WHEN 1 THEN 'message.complained' ELSE 'message.rejected' END"
    )
    error_key = "CASE event_id % 3 WHEN 0 THEN 'bounce' WHEN 1 THEN 'complaint' ELSE 'rejection' END"
    # A mail states a time up to 400 seconds before its call.
    mail = (
        "concat('{\"event_type\":\"message.received\",\"event_id\":\"', event_id % 9000, '\",\"message\":{\"message_id\":\"m',"
        " event_id, '\",\"thread_id\":\"t', user_id, '\",\"from\":\"user', user_id, '@example.org\",\"subject\":\"Re: ', event_id,"
        " '\",\"text\":\"text of ', event_id, '\",\"timestamp\":\"',"
        " date_format(ts - make_interval(0, 0, 0, 0, 0, 0, event_id % 400), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), '\"}}')"
    )
    return events.selectExpr(
        "CAST(event_id AS STRING) AS id",
        "concat('w', user_id % 7) AS webhook_id",
        "map('user-agent', event_type) AS headers",
        "CASE WHEN event_id % 10 = 0 THEN concat('not json ', event_id)"
        " WHEN event_type = 'signup' THEN " + typed % ("'message.sent'", "'send'") +
        " WHEN event_type = 'view' THEN " + typed % ("'message.delivered'", "'delivery'") +
        " WHEN event_type = 'error' THEN " + typed % (error_type, error_key) +
        " WHEN event_type = 'purchase' THEN " + mail +
        " ELSE props END AS raw_body",
        "CAST(ts AS TIMESTAMP) AS received_at",
    )


def webhooks(spark: SparkSession, sf: str) -> DataFrame:
    """Five webhooks; two more that events name have been deleted."""
    return table(spark, sf, "region").selectExpr(
        "concat('w', r_regionkey) AS id",
        "r_name AS name",
        "CASE WHEN r_regionkey % 2 = 0 THEN 'agentmail' WHEN r_regionkey = 1 THEN 'generic' END AS service",
    )


def replies(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Turns as inbound replies; some threads are unknown."""
    return _rows(spark, sf, "conversations", given).selectExpr(
        "concat('r', conv_id, '-', turn) AS id",
        "CASE WHEN conv_id % 9 <> 0 THEN concat('t', conv_id * 20) END AS agentmail_thread_id",
        "CASE WHEN conv_id % 8 <> 0 THEN concat('user', conv_id, '@example.org') END AS `from`",
        "CASE WHEN turn % 4 <> 0 THEN concat('Re: ', role, ' ', conv_id) END AS subject",
        "text",
        "CAST(timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, conv_id, turn) AS TIMESTAMP) AS received_at",
    )


def activity(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Feed rows that agents logged, with ids of many kinds in their details."""
    return _rows(spark, sf, "events", given).selectExpr(
        "concat('a', event_id) AS id",
        "CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) END AS agent_id",
        "CASE event_type WHEN 'signup' THEN 'content' WHEN 'view' THEN 'research' WHEN 'click' THEN 'email'"
        " WHEN 'purchase' THEN 'mystery' ELSE 'error' END AS category",
        "CASE WHEN event_id % 3 = 0 THEN concat('Landing Page ', event_id, ' published')"
        " ELSE concat('Did ', event_type, ' ', event_id) END AS summary",
        "CASE event_id % 8 WHEN 0 THEN concat('{\"campaign_id\":\"', user_id, '\",\"reply_id\":\"r\"}')"
        " WHEN 1 THEN '{\"campaign_id\":\"\",\"reply_id\":\"r1\"}'"
        " WHEN 2 THEN concat('{\"slug\":\"s', user_id, '\"}') WHEN 3 THEN '{\"task_id\":\"t1\"}'"
        " WHEN 4 THEN '{\"session_id\":\"v1\"}' WHEN 5 THEN '{\"invitation_id\":\"i1\"}'"
        " WHEN 6 THEN props END AS details",
        "CAST(ts AS TIMESTAMP) AS created_at",
    )


def agents(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    return _rows(spark, sf, "supplier", given).selectExpr(
        "CAST(s_suppkey AS STRING) AS id",
        "s_name AS name",
        "replace(lower(s_name), '#', '-') AS sign_in_name",
        "CASE WHEN s_suppkey % 5 <> 0 THEN concat('e', s_suppkey % 7) END AS emoji",
        "CASE s_suppkey % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'idle' WHEN 2 THEN 'offline' ELSE 'error' END AS status",
        "CASE WHEN s_suppkey % 3 = 0 THEN CAST(timestamp_ntz'2024-01-02 00:00:00' AS TIMESTAMP) END AS last_heartbeat",
        "CAST(timestamp_ntz'2023-12-01 00:00:00' AS TIMESTAMP) AS created_at",
    )


def tasks(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    return _rows(spark, sf, "orders", given).selectExpr(
        "CAST(o_orderkey AS STRING) AS id",
        "concat('Order ', o_orderkey) AS title",
        "CASE WHEN o_orderstatus = 'P' THEN 'blocked' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing'"
        " WHEN 2 THEN 'needs_input' WHEN 3 THEN 'canceled' WHEN 4 THEN 'done' END END AS status",
        "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) END AS assignee_id",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    )


def changed_things(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """What changes tasks, replies, agents, sessions, pages and campaigns, by kind of feed source."""
    listed = campaigns(spark, sf)
    run = listed.selectExpr("id", "id AS campaign_id", "name", "concat('run', id) AS apify_run_id", "created_at")
    counted = listed.selectExpr(
        "id", "id AS campaign_id", "name", "coalesce(leads_imported, 0L) AS imported", "coalesce(emails_sent, 0L) AS sent",
        "emails_delivered AS total", "emails_bounced AS errors", "emails_clicked AS generated", "created_at AS finished_at",
    )
    return {
        "task_moves": tasks(spark, sf).selectExpr("id", "title", "coalesce(status, 'todo') AS status", "assignee_id", "created_at AS updated_at"),
        "converted_replies": tasks(spark, sf).selectExpr("id", "title", "concat('r', id) AS reply_id", "created_at"),
        "deleted_agents": agents(spark, sf).selectExpr("id", "created_at AS deleted_at"),
        "sessions": sessions(spark, sf).selectExpr("id", "concat('Voice session ', id) AS summary", "ended_at"),
        "page_updates": pages(spark, sf).selectExpr(
            "slug AS id", "slug", "CASE WHEN linked_form_slug IS NOT NULL THEN title END AS title",
            "CASE WHEN linked_form_slug IS NULL THEN array() ELSE array('title', 'theme') END AS changed", "created_at AS updated_at"),
        "scrape_starts": run.withColumnRenamed("created_at", "started_at"),
        "scrape_imports": counted,
        "draft_batches": counted,
        "send_runs": counted,
    }


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts as they are asked for, with odd steps, totals and frameworks."""
    return table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS id",
        "CASE o_orderkey % 5 WHEN 0 THEN 'pas' WHEN 1 THEN 'aida' WHEN 2 THEN 'odd' WHEN 3 THEN 'one-off' END AS framework",
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 9 - 1.5D END AS step",
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 + 0.5D END AS total_steps",
    )


def forms(spark: SparkSession, sf: str) -> DataFrame:
    """One form per part; the field lists are as an agent sends them."""
    return table(spark, sf, "part").selectExpr(
        "concat('form-', p_partkey) AS slug",
        "p_name AS title",
        "array("
        " named_struct('label', 'Key', 'name', 'k', 'type', 'number', 'required', true),"
        " named_struct('label', concat(p_name, '!'), 'name', CAST(NULL AS STRING), 'type', upper(p_type), 'required', CAST(NULL AS BOOLEAN)),"
        " named_struct('label', CAST(NULL AS STRING), 'name', CASE WHEN p_partkey % 2 = 0 THEN ' E-Mail ' END,"
        "   'type', CASE WHEN p_partkey % 3 <> 0 THEN 'EMAIL' END, 'required', p_partkey % 5 = 0)"
        ") AS fields",
    )


def raw_submissions(events: DataFrame) -> DataFrame:
    """Posted forms: some broken, some empty, some for forms that do not exist."""
    return events.selectExpr(
        "concat('s', event_id) AS id",
        "concat('form-', user_id * 3) AS form_slug",
        "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{broken' ELSE concat('{\"k\":\"',"
        " get_json_object(props, '$.k'), '\",\"e_mail\":\"', CASE WHEN event_id % 2 = 0 THEN 'a@b.test' ELSE '' END, '\"}') END AS body",
        "CAST(ts AS TIMESTAMP) AS received_at",
    )


def pages(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """Published pages: crawled HTML, some with form markers, linked forms or leading blanks."""
    return _rows(spark, sf, "pages", given).selectExpr(
        "concat('page-', page_id) AS slug",
        "concat('Page ', page_id) AS title",
        "CASE page_id % 4 WHEN 0 THEN concat(html, '{{FORM:form-', page_id * 9, '}}{{form:Form-', page_id, '}}')"
        " WHEN 1 THEN concat('\\n\\t ', html) WHEN 2 THEN concat('<div>', html) ELSE html END AS html_body",
        "CASE WHEN page_id % 3 = 0 THEN concat('form-', page_id * 11) END AS linked_form_slug",
        "CAST(timestamp_ntz'2024-01-05 00:00:00' AS TIMESTAMP) AS created_at",
    )


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by site and documents by source, with addresses of every kind added to the pages."""
    web = table(spark, sf, "pages").selectExpr(
        "try_parse_url(url, 'HOST') AS site",
        "CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/contact' WHEN 2 THEN '/contact-us' ELSE concat('/p/', page_id) END AS path",
        "concat(html, CASE page_id % 9 WHEN 0 THEN '<img src=\"logo@2x.png\">'"
        " WHEN 1 THEN concat('<a href=\"MAILTO:Jo', page_id, '@Firm.test?subject=x\">')"
        " WHEN 2 THEN 'test@firm.test hello@firm.test' WHEN 3 THEN 'a@b.wixsite.com'"
        " WHEN 4 THEN concat('x', page_id, '@firm.test or Info@firm.test') ELSE '' END) AS content",
    )
    docs = table(spark, sf, "documents").selectExpr(
        "source AS site", "concat('/d/', lpad(CAST(doc_id AS STRING), 12, '0')) AS path",
        "concat(text, CASE WHEN doc_id % 70 = 3 THEN concat(' mail Doc', doc_id, '@', source, '.test') ELSE '' END) AS content",
    )
    return web.unionByName(docs)


def scraped_items(spark: SparkSession, sf: str) -> DataFrame:
    """Scraped JSON items with missing keys, numbers as text and odd addresses."""
    parts = [
        "CASE WHEN c_custkey % 7 NOT IN (0, 1) THEN concat('\"title\":\"', c_name, '\"') END",
        "CASE WHEN c_custkey % 7 = 0 THEN concat('\"subTitle\":\"Sub ', c_custkey, '\"') END",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('\"phoneUnformatted\":\"+1', c_custkey, '\"')"
        " WHEN c_custkey % 3 = 1 THEN '\"phone\":\"\"' END",
        "concat('\"category\":\"', c_mktsegment, '\"')",
        "CASE WHEN c_custkey % 2 = 0 THEN '\"categoryName\":\"Shop\"' END",
        "CASE c_custkey % 4 WHEN 0 THEN '\"emails\":[\"none\",\"a@b.test\",\"c@d.test\"]' WHEN 1 THEN '\"emails\":[\"x\"]' END",
        "CASE WHEN c_custkey % 5 = 0 THEN '\"totalScore\":\"4.5\"' ELSE concat('\"totalScore\":', c_custkey % 5) END",
        "CASE WHEN c_custkey % 6 <> 0 THEN concat('\"reviewsCount\":', c_custkey % 100) END",
        "CASE WHEN c_custkey % 8 = 0 THEN concat('\"website\":\"https://w', c_custkey, '.test\"') END",
    ]
    return table(spark, sf, "customer").selectExpr(
        "CAST(c_nationkey AS STRING) AS campaign_id",
        "c_custkey AS item_no",
        f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}') AS item",
    )


def search_plans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS plan_id",
        "concat('  wanted: ', repeat(p_name, 12)) AS query",
        "CASE p_partkey % 3 WHEN 0 THEN concat('  ', p_type, '\\t') WHEN 1 THEN ' \\u00a0 ' END AS location",
        "CASE p_partkey % 4 WHEN 0 THEN array('', ' ', '\\n') WHEN 1 THEN split(p_name, ' ')"
        " WHEN 2 THEN array(' a ', '', 'b', 'c', 'd ', 'e', 'f', p_brand) END AS search_terms",
        "CASE WHEN p_partkey % 5 <> 0 THEN p_size * 7.5D - 10 END AS max_results",
        "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS max_results_hint",
    )


def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as model answers: plain JSON, fenced JSON, or no JSON."""
    payload = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("  "), F.col("source"), F.lit(" "), F.col("doc_id"))).alias("subject"),
            F.concat(F.col("text"), F.lit("\n ")).alias("body_text"),
        )
    )
    answer = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```JSON\n"), payload, F.lit("\n```  \n")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Sure! "), payload))
        .otherwise(payload)
    )
    return table(spark, sf, "documents").select("doc_id", answer.alias("text"))


def send_results(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of a send run per drafted e-mail; the runs of a few campaigns failed altogether."""
    ok = (F.col("campaign_id").cast("int") % 5 != 0) & (F.col("id").cast("bigint") % 10 != 0)
    return emails(spark, sf).filter("status = 'drafted'").select("campaign_id", F.col("id").alias("email_id"), ok.alias("ok"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS campaign_id",
        "CASE WHEN o_orderkey % 4 <> 0 THEN 'searching' ELSE 'draft' END AS status",
        "CASE WHEN o_orderkey % 9 <> 0 THEN concat('run', o_orderkey) END AS run_id",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'SUCCEEDED' WHEN '2-HIGH' THEN 'FAILED' WHEN '3-MEDIUM' THEN 'ABORTED'"
        " WHEN '4-NOT SPECIFIED' THEN 'TIMED-OUT' ELSE 'RUNNING' END AS run_status",
        "CASE WHEN o_orderstatus = 'P' THEN concat('msg ', o_custkey) END AS run_message",
        "CASE WHEN o_orderkey % 6 <> 0 THEN 'd1' END AS run_dataset_id",
        "CASE WHEN o_orderkey % 12 = 0 THEN 'd2' END AS campaign_dataset_id",
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change log per customer: whole documents, patches and deletions."""
    return table(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS id",
        "CAST(o_orderdate AS TIMESTAMP) AS at",
        "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 10 = 9 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'put' ELSE 'patch' END AS op",
        "CASE WHEN o_orderkey % 4 <> 0 THEN concat('title ', o_orderkey) END AS title",
        "CASE WHEN o_orderkey % 5 < 2 THEN o_orderpriority END AS priority",
    )


def task_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change log of tasks, one per customer."""
    return table(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS id",
        "CAST(o_orderdate AS TIMESTAMP) AS at",
        "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 10 = 9 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'put' ELSE 'patch' END AS op",
        "CASE WHEN o_orderkey % 4 <> 0 THEN concat('Task ', o_orderkey) END AS title",
        "CASE o_orderkey % 5 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing' WHEN 2 THEN 'done' END AS status",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat('agent', o_orderkey % 7) END AS assignee_id",
    )


def page_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change log of published pages, one per user."""
    return table(spark, sf, "events").selectExpr(
        "concat('page-', user_id) AS slug",
        "CAST(ts AS TIMESTAMP) AS at",
        "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op",
        "CASE WHEN event_id % 4 <> 0 THEN concat('Page ', event_id) END AS title",
        "CASE WHEN event_id % 3 = 0 THEN 'dark' END AS theme",
    )


def transcript_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as live transcript chunks: two in a row have the same speaker, a third are final."""
    return table(spark, sf, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS session_id",
        "turn AS seq",
        "CASE WHEN turn % 4 < 2 THEN 'user' ELSE 'agent' END AS role",
        "CASE WHEN turn % 7 = 5 THEN ' \\n' ELSE text END AS text",
        "turn % 3 = 0 AS final",
    )


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls of 97 sessions; the result of a call often comes with a later equal one."""
    return table(spark, sf, "events").selectExpr(
        "CAST(user_id % 97 AS STRING) AS session_id",
        "event_id AS seq",
        "event_type AS name",
        "concat('{\"k\":', CAST(get_json_object(props, '$.k') AS INT) % 5, '}') AS params",
        "CASE WHEN event_id % 3 = 0 THEN concat('result ', event_id) END AS result",
        "CASE WHEN event_id % 7 = 0 THEN concat('error ', event_id) END AS error",
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with their times, from the turns of each conversation."""
    return (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("last_turn"))
        .selectExpr(
            "CAST(conv_id AS STRING) AS id",
            "CASE WHEN conv_id % 3 <> 0 THEN concat('i', conv_id % 150) END AS invitation_id",
            "CAST(timestamp_ntz'2024-04-01 00:00:00' + make_interval(0, 0, 0, 0, 0, conv_id) AS TIMESTAMP) AS started_at",
            "CAST(timestamp_ntz'2024-04-01 00:00:00' + make_interval(0, 0, 0, 0, 0, conv_id, last_turn * 13.5) AS TIMESTAMP) AS ended_at",
        )
    )


def invitations(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    return _rows(spark, sf, "supplier", given).selectExpr(
        "concat('i', s_suppkey) AS id",
        "s_name AS agent_name",
        "CAST(s_suppkey AS STRING) AS agent_id",
        "concat('about nation ', s_nationkey) AS reason",
        "CASE s_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'dismissed' END AS status",
        "CAST(timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, s_nationkey) AS TIMESTAMP) AS created_at",
    )


def probes(spark: SparkSession, sf: str, given: DataFrame | None = None) -> DataFrame:
    """A health probe up to 19 seconds before each event, so that some see it arrive in time."""
    return _rows(spark, sf, "events", given).selectExpr(
        "CAST(event_id AS STRING) AS probe_id",
        "concat('w', user_id % 7) AS webhook_id",
        "CAST(ts - make_interval(0, 0, 0, 0, 0, 0, event_id % 20) AS TIMESTAMP) AS since",
    )
