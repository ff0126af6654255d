"""Matching of events, replies and clicks on hand-made rows."""

import datetime

from heliograph.operators import correlation
from heliograph.sources import ingest

DAY = datetime.datetime(2024, 1, 1)
EMAILS = "id string, campaign_id string, lead_id string, status string, agentmail_message_id string, agentmail_thread_id string, created_at timestamp"


def emails(spark):
    return spark.createDataFrame(
        [
            ("e1", "a", "l1", "sent", "m1", "t1", DAY),
            ("e2", "a", "l2", "replied", "m2", "t1", DAY + datetime.timedelta(1)),
            ("e3", "b", "l3", "sent", "", "", DAY),
            ("e4", "b", "l4", "sent", None, "t4", DAY),
        ],
        EMAILS,
    )


def test_an_earlier_thread_match_beats_a_later_message_match(spark):
    events = spark.createDataFrame(
        [("1", "m2", "t1"), ("2", "m2", None), ("3", None, "t4"), ("4", "", ""), ("5", None, None), ("6", "mx", "tx")],
        "id string, message_id string, thread_id string",
    )
    got = {r["id"]: r["email_id"] for r in correlation.correlate_events(events, emails(spark)).collect()}
    assert got == {"1": "e1", "2": "e2", "3": "e4"}
    kept = correlation.correlate_events(events, emails(spark), keep_unmatched=True)
    assert kept.count() == 6


def test_unknown_threads_stay_unassigned(spark):
    replies = spark.createDataFrame([("r1", "t1"), ("r2", "zz"), ("r3", None)], "id string, agentmail_thread_id string")
    got = {r["id"]: (r["campaign_id"], r["original_email_id"], r["partition"]) for r in
           correlation.correlate_replies(replies, emails(spark)).collect()}
    assert got == {"r1": ("a", "e1", "a"), "r2": (None, None, "unassigned"), "r3": (None, None, "unassigned")}


def test_clicks_need_the_right_campaign(spark):
    clicks = spark.createDataFrame(
        [("k1", "a", "e2"), ("k2", "b", "e2"), ("k3", "a", "e1")], "id string, campaign_id string, email_id string"
    )
    got = {r["id"]: (r["matched"], r["status_after"]) for r in correlation.attribute_clicks(clicks, emails(spark)).collect()}
    assert got == {"k1": (True, "replied"), "k2": (False, None), "k3": (True, "clicked")}


def test_webhook_bodies(spark):
    raw = spark.createDataFrame(
        [
            ("1", "w1", None, '{"event_type":"message.sent","send":{"message_id":"m"},"delivery":{"thread_id":"t"}}', DAY),
            ("2", "w1", None, '{"event_type":"message.delivered","send":{"inbox_id":"i"},"delivery":{"thread_id":"t"}}', DAY),
            ("3", "w2", None, "plain text", DAY),
            ("4", "w2", None, '{"event_type":"message.rejected"}', DAY),
            ("5", "w2", None, '{"event_type":"other"}', DAY),
            ("6", "gone", None, '{"event_type":"message.sent"}', DAY),
            ("7", "w1", None, "[1]", DAY),
        ],
        "id string, webhook_id string, headers map<string,string>, raw_body string, received_at timestamp",
    )
    events = ingest.parse_webhook_events(raw)
    assert {r["id"] for r in events.filter("is_json").collect()} == {"1", "2", "4", "5", "6", "7"}
    ids = {r["id"]: (r["message_id"], r["thread_id"]) for r in correlation.extract_message_ids(events).collect()}
    assert ids["1"] == ("m", None) and ids["2"] == (None, "t") and ids["3"] == (None, None)
    hooks = spark.createDataFrame([("w1", "agentmail"), ("w2", None)], "id string, service string")
    assert {r["id"] for r in correlation.route_events(events, hooks).collect()} == {"1", "2", "4", "7"}
    status = {r["id"]: r["status"] for r in correlation.classify_event(events).collect()}
    assert status == {"1": "sent", "2": "delivered", "4": "failed", "6": "sent"}


def test_token_rules(spark):
    import base64
    import json

    def pack(payload):
        return base64.urlsafe_b64encode(json.dumps(payload).encode()).decode().rstrip("=")

    rows = [
        ("1", pack({"c": "c", "l": "l", "e": "e", "u": "u"})), ("2", "%%%"), ("3", pack({"c": "c", "e": "e"})),
        ("4", pack({"u": "u"})), ("5", pack({"c": "", "e": "e", "u": "u"})), ("6", pack({"u": ""})),
    ]
    got = ingest.decode_click_tokens(spark.createDataFrame(rows, "id string, token string")).collect()
    assert {r["id"]: r["logged"] for r in got} == {"1": True, "4": False, "5": False}


def test_orphans(spark):
    children = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", None), ("4", "")], "id string, campaign_id string")
    parents = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in correlation.orphans(children, parents, "campaign_id").collect()] == ["2"]


def test_redelivered_events(spark):
    events = spark.createDataFrame(
        [("1", "x", DAY), ("2", "x", DAY), ("3", None, DAY), ("4", None, DAY)], "id string, event_id string, received_at timestamp"
    )
    assert {r["id"] for r in correlation.dedupe_deliveries(events).collect()} == {"1", "3", "4"}
