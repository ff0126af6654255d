"""Tokens and calls are parsed once per row, whatever is filtered and read of them after."""

from pyspark.sql import functions as F

from heliograph.functions import tokens
from heliograph.sources import ingest


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens(spark):
    payload = tokens.encode_click_token(*(F.lit(c) for c in ("c1", "l1", "e1")), F.lit("https://shop.test/?a_b-c=1"))
    packed = spark.range(1).select(payload).first()[0]
    given = [packed, f"!{packed[:9]} \n{packed[9:]}=", f"x{packed}", packed + "A", "e30", "", "é_-", None]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(given)], "id string, token string")
    clicks = ingest.decode_click_tokens(rows)
    plan = optimized(clicks.filter("logged"))
    assert [plan.count(f"{name}(") for name in ("from_json", "unbase64", "regexp_replace", "parseJson")] == [1, 1, 1, 1]
    whole = rows.select("id", tokens.decode_click_token(F.col("token")).alias("p")).filter("p.u <> ''")
    expected = {(r.id, r.p.c, r.p.l, r.p.e, r.p.u) for r in whole.collect()}
    assert {(r.id, r.campaign_id, r.lead_id, r.email_id, r.url) for r in clicks.collect()} == expected
    assert {"0", "1"} <= {i for i, *_ in expected}


def test_calls_and_submissions(spark):
    given = ['{"event_type":"message.sent","send":{"message_id":"m"}}', "{}", "not json", "{broken", "", None]
    raw = spark.createDataFrame([(str(i), "w", b) for i, b in enumerate(given)], "id string, webhook_id string, body string")
    raw = raw.withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    calls = ingest.parse_webhook_events(raw.select("id", "webhook_id", F.lit(None).alias("headers"), F.col("body").alias("raw_body"), "received_at"))
    sent = calls.filter((F.col("event.event_type") == "message.sent") & (F.col("event.send.message_id") == "m"))
    plan = optimized(sent)
    assert [plan.count(f"{name}(") for name in ("from_json", "parseJson")] == [1, 1]
    assert [r.id for r in sent.collect()] == ["0"]
    assert {r.id for r in calls.filter("is_json").collect()} == {"0", "1"}
    posted = ingest.parse_submissions(raw.withColumn("form_slug", F.lit("f")), spark.createDataFrame([("f",)], "slug string"))
    assert {r.id for r in posted.collect()} == {"0", "1", "5"}
