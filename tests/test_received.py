"""What comes in, on top of what is stored: replies from calls, arrival order, counters, single fixes."""

import datetime

from pyspark.sql import functions as F

from heliograph.functions.html import form_markers
from heliograph.functions.tokens import decode_click_token, encode_click_token
from heliograph.operators import correlation, leads, lifecycle, sequence
from heliograph.sources.entities import read_entity, write_partitioned
from heliograph.sources.ingest import parse_webhook_events

START = datetime.datetime(2024, 1, 1, 10)
EVENT = "email_id string, campaign_id string, at timestamp, event_id string, status string, kind string, stamp timestamp"


def minute(n):
    return START + datetime.timedelta(minutes=n)


def event(key, n, status, kind, stamp=None):
    return (key, "c", minute(n), f"{n:03d}", status, kind, stamp or minute(n))


def with_status(spark, stored, events):
    mails = spark.createDataFrame(stored, "id string, status string, click_count long, last_clicked_at timestamp")
    rows = lifecycle.with_status(mails, spark.createDataFrame(events, EVENT)).collect()
    return {r["id"]: r.asDict() for r in rows}


def test_stored_status_is_not_lowered(spark):
    got = with_status(
        spark,
        [("a", "replied", 5, minute(-9)), ("b", "sent", None, None), ("c", "clicked", 2, minute(-9)), ("d", "bounced", None, None), ("e", None, None, None)],
        [event("a", 1, "delivered", "provider"), event("b", 1, "delivered", "provider"), event("b", 2, "clicked", "click"),
         event("d", 1, "sent", "provider"), event("e", 1, "bounced", "provider"), event("e", 2, "delivered", "provider")],
    )
    assert (got["a"]["status"], got["a"]["click_count"], got["a"]["last_clicked_at"], got["a"]["delivered_at"]) == ("replied", 5, minute(-9), None)
    assert (got["b"]["status"], got["b"]["click_count"], got["b"]["delivered_at"]) == ("clicked", 1, minute(1))
    assert (got["c"]["status"], got["c"]["click_count"], got["c"]["last_clicked_at"]) == ("clicked", 2, minute(-9))
    assert got["d"]["status"] == "sent" and got["e"]["status"] == "delivered" and got["e"]["bounced_at"] == minute(1)


def test_a_reply_takes_effect_when_it_arrives(spark):
    got = with_status(spark, [("a", "sent", None, None)], [event("a", 3, "bounced", "provider"), event("a", 5, "replied", "reply", minute(0))])
    assert (got["a"]["status"], got["a"]["replied_at"]) == ("replied", minute(0))


def test_replies_from_calls(spark):
    body = '{"event_type":"message.received","message":{"message_id":"m","thread_id":"t","from":"x@y.test","to":["a"],"text":"hi"%s}}'
    calls = spark.createDataFrame(
        [("1", "w", None, body % ',"timestamp":"2024-01-01T09:00:00Z"', minute(5)), ("2", "w", None, body % "", minute(6)),
         ("3", "w", None, '{"event_type":"message.received"}', minute(7)), ("4", "w", None, '{"event_type":"message.sent"}', minute(8))],
        "id string, webhook_id string, headers map<string,string>, raw_body string, received_at timestamp",
    )
    got = {r["id"]: r for r in correlation.extract_replies(parse_webhook_events(calls)).collect()}
    assert set(got) == {"reply-1", "reply-2"}
    assert (got["reply-1"]["received_at"], got["reply-1"]["arrived_at"]) == (minute(-60), minute(5))
    assert got["reply-2"]["received_at"] == minute(6) and got["reply-1"]["to"] == ["a"]


def test_every_logged_click_counts(spark):
    marked = spark.createDataFrame([("c", "provider", True, "delivered"), ("c", "click", True, "clicked")], "campaign_id string, kind string, applied boolean, status string")
    clicks = spark.createDataFrame([("c",), ("c",), ("d",)], "campaign_id string")
    got = {r["campaign_id"]: tuple(r)[1:] for r in lifecycle.count_logged_clicks(lifecycle.event_counters(marked), clicks).collect()}
    assert got == {"c": (1, 0, 2, 0), "d": (0, 0, 1, 0)}


def test_ranks_carry_over(spark):
    events = spark.createDataFrame([event("a", 1, "delivered", "provider"), event("b", 1, "bounced", "provider")], EVENT)
    before = spark.createDataFrame([("a", 4), ("b", 4), ("z", 3)], "email_id string, rank int")
    assert {tuple(r) for r in lifecycle.ranks_after(events, before).collect()} == {("a", 4), ("b", 0), ("z", 3)}
    marked = {r["email_id"]: r["applied"] for r in lifecycle.mark_applied(events, entered=before).collect()}
    assert marked == {"a": False, "b": True}


def test_folder_keys_are_text(spark, tmp_path):
    df = spark.createDataFrame([("1", "007", "https://u")], "id string, campaign_id string, url string")
    for fmt in ("json", "parquet"):
        write_partitioned(df, f"{tmp_path}/{fmt}", "campaign_id", fmt=fmt)
        assert [r["campaign_id"] for r in read_entity(spark, f"{tmp_path}/{fmt}", "clicks", fmt=fmt).collect()] == ["007"]
        assert read_entity(spark, f"{tmp_path}/{fmt}", "clicks", partition="007", fmt=fmt).count() == 1


def test_single_rules(spark):
    one = spark.range(1)
    token = encode_click_token(F.lit("c"), F.lit("l"), F.lit("e"), F.lit("https://u"))
    odd = F.concat(F.lit(" !"), F.substring(token, F.lit(1), F.lit(9)), F.lit("\n%"), F.substring(token, F.lit(10), F.lit(999)), F.lit("=="))
    assert one.select(decode_click_token(odd)["u"]).first()[0] == "https://u"
    assert one.select(decode_click_token(F.concat(F.lit("x"), token))["u"]).first()[0] is None
    marks = lambda text: one.select(form_markers(F.lit(text))).first()[0]
    assert marks("{{form:x {{form:a}} {{FORM:B c}} {{form:}} {{form:d") == ["a", "b c"]
    people = spark.createDataFrame([("1", None, "https://ACME.test/x"), ("2", None, "https://other.test")], "id string, email string, website string")
    contacts = spark.createDataFrame([("Acme.test", "b@acme.test"), ("acme.TEST", "a@acme.test"), ("other.test", None)], "site string, email string")
    assert {r["id"]: r["email"] for r in leads.enrich_leads(people, contacts).collect()} == {"1": "a@acme.test", "2": None}
    drafts = spark.createDataFrame(
        [("1", "c", None, 1, START), ("2", "c", None, 1, START), ("3", "c", "l", 1, START), ("4", "c", "l", 1, minute(1))],
        "id string, campaign_id string, lead_id string, sequence_position int, created_at timestamp",
    )
    got = {r["id"]: r["skipped"] for r in sequence.dedupe_new_drafts(drafts, drafts.limit(0)).collect()}
    assert got == {"1": False, "2": False, "3": False, "4": True}
