"""Leads, sequences and funnel on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from heliograph.operators import funnel, leads, sequence
from heliograph.sources import ingest

DAY = datetime.datetime(2024, 1, 1)
EMAILS = """id string, campaign_id string, lead_id string, status string, click_count bigint, sequence_position int,
    framework string, created_at timestamp"""


def emails(spark, rows):
    return spark.createDataFrame(rows, EMAILS)


def test_counters_with_missing_status(spark):
    rows = [
        ("1", "a", "l1", None, None, None, None, DAY), ("2", "a", "l2", "", None, None, None, DAY),
        ("3", "a", "l3", "bounced", 2, 1, "pas", DAY), ("4", "a", "l4", "drafted", None, 3, None, DAY),
        ("5", "gone", "l5", "replied", None, 1, None, DAY),
    ]
    campaigns = spark.createDataFrame([("a", "A", DAY, 3), ("b", "B", None, None)], "id string, name string, created_at timestamp, leads_imported bigint")
    got = {r["id"]: r for r in funnel.campaign_summary(campaigns, emails(spark, rows)).collect()}
    assert got["a"][4:] == (1, 0, 1, 1, 0) and got["b"][4:] == (0, 0, 0, 0, 0)
    totals = funnel.outreach_totals(campaigns, emails(spark, rows)).first()
    assert tuple(totals) == (2, 3, 1, 0, 1, 1, 0)
    assert tuple(funnel.outreach_totals(campaigns.limit(0), emails(spark, rows)).first()) == (0,) * 7
    people = spark.createDataFrame([("l1", "a", "x@y"), ("l2", "a", "")], "id string, campaign_id string, email string")
    page = {r["campaign_id"]: r for r in funnel.campaign_counters(people, emails(spark, rows)).collect()}
    assert page["a"].asDict() == dict(
        campaign_id="a", leads=2, leads_with_email=1, drafts=1, sent=3, delivered=0, bounced=1, clicked=1, replied=0
    )
    steps = {r["step"]: r for r in funnel.step_stats(emails(spark, rows)).filter("campaign_id = 'a'").collect()}
    assert set(steps) == {1, 2, 3} and steps[2]["sent"] == 0 and steps[3]["drafted"] == 1 and steps[1]["is_sequence"]


def test_step_label_is_that_of_the_newest(spark):
    later = DAY + datetime.timedelta(1)
    rows = [("1", "a", "l", "sent", None, 1, "pas", DAY), ("2", "a", "l", "sent", None, 1, None, later)]
    assert funnel.step_stats(emails(spark, rows)).first()["framework"] is None


def test_rates(spark):
    df = spark.createDataFrame(
        [("a", 0, 0, 0, 0, 0), ("b", 100, 50, 5, 10, 1), ("c", 200, 1, 9, 1, 1)],
        "id string, emails_sent bigint, emails_delivered bigint, emails_bounced bigint, emails_clicked bigint, emails_replied bigint",
    )
    got = {r["id"]: (r["delivery_rate"], r["bounce_rate"], r["reply_rate"], r["unhealthy"]) for r in funnel.funnel_rates(df).collect()}
    assert got == {"a": (None, None, None, False), "b": (50, 5, 1, True), "c": (1, 5, 1, False)}


def test_gate(spark):
    stats = spark.createDataFrame(
        [("a", 1, 2, 0), ("a", 2, 1, 0), ("b", 1, 0, 3), ("b", 2, 1, 0)], "campaign_id string, step int, drafted bigint, sent bigint"
    )
    got = {(r["campaign_id"], r["step"]): r["sendable"] for r in funnel.step_gate(stats).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("b", 1): False, ("b", 2): True}


def people(spark):
    return spark.createDataFrame(
        [("l1", "a", "Ann", "Ann", "a@b", None, None, "c", None), ("l2", "a", "Bo", "Bo Inc", None, "http://w", None, None, None)],
        "id string, campaign_id string, name string, company string, email string, website string, address string, category string, notes string",
    )


def test_plan_counts_a_missing_step_as_the_first(spark):
    existing = emails(spark, [("1", "a", "l1", "drafted", None, None, None, DAY)])
    plan = sequence.plan_sequence(people(spark), existing, 3)
    assert sorted((r["lead_id"], r["step"]) for r in plan.collect()) == [("l1", 2), ("l1", 3)]
    r = sequence.plan_summary(people(spark), existing, 3).first()
    assert tuple(r) == ("a", 2, 1, 1, 1)
    assert [(r["step"], r["lead_id"]) for r in sequence.draft_work_order(plan).collect()] == [(2, "l1"), (3, "l1")]


def test_context_parts(spark):
    existing = emails(spark, [("1", "a", "l1", "drafted", None, None, None, DAY)]).withColumn("subject", F.lit("Hi")).withColumn("body_text", F.lit(None).cast("string"))
    plan = sequence.plan_sequence(people(spark), existing, 2)
    campaigns = spark.createDataFrame([("a", "cafes")], "id string, query string")
    parts = sequence.draft_context(plan, people(spark), campaigns, existing, total_steps=2).orderBy("part").collect()
    assert [p["part"] for p in parts] == ["context", "heading", "previous"]
    assert parts[0]["text"] == "RECIPIENT\nBusiness: Ann\nCategory: c\n\nSENDER\nICP context: cafes\n\nFRAMEWORK: pas\nSTEP: 2 of 2"
    assert "\n".join(p["text"] for p in parts[1:]) == (
        "PREVIOUS STEPS (for continuity — reference implicitly, never copy):\n--- STEP 1 ---\nSubject: Hi\n\n"
    )
    alone = sequence.draft_context(plan, people(spark), campaigns, existing, framework="one-off").collect()
    assert len(alone) == 1 and "FRAMEWORK" not in alone[0]["text"]


def test_new_drafts(spark):
    later = DAY + datetime.timedelta(1)
    new = emails(spark, [
        ("n1", "a", "l1", "drafted", None, 1, None, DAY), ("n2", "a", "l2", "drafted", None, None, None, later),
        ("n3", "a", "l2", "drafted", None, 1, None, DAY), ("n4", "a", "l2", "drafted", None, 2, None, DAY),
    ])
    existing = emails(spark, [("1", "a", "l1", "sent", None, None, None, DAY)])
    got = {r["id"]: r["skipped"] for r in sequence.dedupe_new_drafts(new, existing).collect()}
    assert got == {"n1": True, "n2": True, "n3": False, "n4": False}


def test_sendable(spark):
    rows = [
        ("1", "a", "l1", "replied", None, 1, None, DAY), ("2", "a", "l1", "drafted", None, 2, None, DAY),
        ("3", "a", "l1", "drafted", None, None, None, DAY), ("4", "a", "l2", "drafted", None, 2, None, DAY),
        ("5", "b", "l1", "drafted", None, 2, None, DAY), ("6", "a", "l9", "sent", None, 2, None, DAY),
    ]
    df = emails(spark, rows)

    def ids(**kw):
        return sorted(r["id"] for r in sequence.select_sendable(df, **kw).collect())

    assert ids() == ["2", "3", "4", "5"]
    assert ids(step=1) == ["3"] and ids(step=2) == ["4", "5"]
    wanted = spark.createDataFrame([("2",), ("2",), ("6",)], "id string")
    assert ids(ids=wanted, step=2) == ["2"]


def test_steps_in_range(spark):
    df = spark.createDataFrame(
        [("1", "pas", 3.7, 9.0), ("2", "x", 0.5, 2.0), ("3", None, 6.0, None), ("4", "aida", None, None), ("5", "one-off", 8.2, None)],
        "id string, framework string, step double, total_steps double",
    )
    got = {r["id"]: (r["framework"], r["step"], r["total_steps"]) for r in sequence.normalize_step(df).collect()}
    assert got == {"1": ("pas", 3, 3), "2": ("one-off", 1, 2), "3": ("one-off", 1, 1), "4": ("aida", 1, 3), "5": ("one-off", 1, 1)}
    got = {r["id"]: (r["framework"], r["step"], r["total_steps"]) for r in sequence.normalize_created_step(df).collect()}
    assert got == {"1": ("pas", 3, 9), "2": ("one-off", 1, 2), "3": ("one-off", 6, 6), "4": ("aida", 1, 1), "5": ("one-off", 8, 8)}


def test_model_answers(spark):
    df = spark.createDataFrame(
        [("1", '{"subject":" Hi ","body_text":"x\\n"}'), ("2", '```json\n{"subject":"  "}\n```'), ("3", "no"), ("4", '{"subject":7}')],
        "id string, text string",
    )
    got = {r["id"]: (r["ok"], r["subject"], r["body_text"]) for r in sequence.normalize_drafts(df).collect()}
    assert got == {"1": (True, "Hi", "x"), "2": (True, "Quick question", ""), "3": (False, None, None), "4": (True, "7", "")}


def test_runs_and_reports(spark):
    runs = spark.createDataFrame(
        [
            ("1", "searching", "r", "SUCCEEDED", None, "d", None), ("2", "searching", "r", "SUCCEEDED", None, None, None),
            ("3", "searching", "r", "TIMED-OUT", "slow", None, None), ("4", "ready", "r", "FAILED", None, None, None),
            ("5", "searching", None, "FAILED", None, None, None), ("6", "searching", "r", "RUNNING", None, None, None),
        ],
        "campaign_id string, status string, run_id string, run_status string, run_message string, run_dataset_id string, campaign_dataset_id string",
    )
    got = {r["campaign_id"]: (r["status"], r["changed"]) for r in sequence.map_run_status(runs).collect()}
    assert got == {"1": ("ready", True), "2": ("failed", True), "3": ("failed", True), "4": ("ready", False),
                   "5": ("searching", False), "6": ("searching", False)}
    results = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "campaign_id string, ok boolean")
    report = {r["campaign_id"]: tuple(r)[1:] for r in sequence.send_report(results).collect()}
    assert report == {"a": (1, 2, 1, "completed"), "b": (0, 1, 1, "failed")}


def test_scraped_items(spark):
    items = ['{"title":"","totalScore":"4.5","emails":["x"]}', '{"subTitle":"S","emails":[1,"a@b"],"reviewsCount":3,"phone":""}', "{}"]
    raw = spark.createDataFrame([("a", i, s) for i, s in enumerate(items)], "campaign_id string, item_no int, item string")
    got = {r["item_no"]: (r["name"], r["rating"], r["email"], r["reviews_count"], r["phone"]) for r in leads.normalize_leads(raw).collect()}
    assert got == {0: ("", None, None, None, None), 1: ("S", None, "a@b", 3, ""), 2: ("Unknown", None, None, None, None)}


def test_import_keeps_the_first_items_of_a_busy_campaign(spark):
    rows = [("a", i, f'{{"title":"n{i}"}}') for i in range(500)] + [("b", i, "{}") for i in range(3)] + [("x", 0, "{}")]
    raw = spark.createDataFrame(rows, "campaign_id string, item_no int, item string").repartition(16)
    campaigns = spark.createDataFrame([("a", (20,)), ("b", (50,))], "id string, structured_query struct<maxResults:int>")
    got = ingest.import_scraped_leads(raw, campaigns).collect()
    assert sorted(r["name"] for r in got if r["campaign_id"] == "a") == sorted(f"n{i}" for i in range(20))
    assert len(got) == 23


def test_contact_search(spark):
    rows = [
        ("junk.test", "", "<img src=logo@2x.png>"), ("junk.test", "/contact", "a@junk.test"),
        ("role.test", "", "jo@a.com, info@a.com"), ("late.test", "", "nothing"), ("late.test", "/contact-us", 'mailto:Z@L.test?x b@l.test'),
        ("deep.test", "/team", "t@deep.test"), ("none.test", "", "x"),
    ]
    pages = spark.createDataFrame(rows, "site string, path string, content string")
    got = {r["site"]: (r["found_on"], r["email"]) for r in leads.extract_contact_emails(pages).collect()}
    assert got == {"junk.test": ("", None), "role.test": ("", "info@a.com"), "late.test": ("/contact-us", "z@l.test"), "none.test": (None, None)}
    deep = leads.extract_contact_emails(pages, other_pages=True).filter("site = 'deep.test'").first()
    assert deep["email"] == "t@deep.test"


def test_search_plan(spark):
    df = spark.createDataFrame(
        [("q" * 90, "  ", ["", " "], None, None), ("q", " Rome ", [" a ", "b", "", "c", "d", "e", "f"], 7.5, None), ("q", None, None, None, 500.0)],
        "query string, location string, search_terms array<string>, max_results double, max_results_hint double",
    )
    got = [tuple(r)[1:] for r in leads.normalize_search_plan(df).collect()]
    assert got == [("Unknown", ["q" * 80], 50, 50), ("Rome", ["a", "b", "c", "d", "e"], 10, 5), ("Unknown", ["q"], 200, 200)]


def test_enriched_leads(spark):
    people = spark.createDataFrame(
        [("1", "x@y", "http://A.test"), ("2", "", "http://A.test/x"), ("3", None, None), ("4", None, "http://b.test"), ("5", None, "not a url")],
        "id string, email string, website string",
    )
    contacts = spark.createDataFrame([("a.test", "info@a.test"), ("b.test", None)], "site string, email string")
    got = {r["id"]: (r["email"], r["enriched"], r["reason"]) for r in leads.enrich_leads(people, contacts).collect()}
    assert got == {
        "1": ("x@y", False, "already had email"), "2": ("info@a.test", True, None), "3": (None, False, "no website to scrape"),
        "4": (None, False, "no email found on website"), "5": (None, False, "no email found on website"),
    }
    assert sorted(r["id"] for r in leads.enrichable_leads(people).collect()) == ["2", "4", "5"]
    assert [r["id"] for r in leads.contactable_leads(people).collect()] == ["1"]


def test_rates_of_the_totals(spark):
    totals = spark.createDataFrame([(10, 5, 1, 2, 3)], "sent bigint, delivered bigint, bounced bigint, clicked bigint, replied bigint")
    r = funnel.funnel_rates(totals, prefix="").first()
    assert (r["delivery_rate"], r["bounce_rate"], r["click_rate"], r["reply_rate"], r["unhealthy"]) == (50, 10, 20, 30, True)


def test_send_run_without_mails_failed(spark):
    results = spark.createDataFrame([("a", True)], "campaign_id string, ok boolean")
    runs = spark.createDataFrame([("a",), ("b",)], "campaign_id string")
    got = {r["campaign_id"]: (r["total"], r["status"]) for r in sequence.send_report(results, runs).collect()}
    assert got == {"a": (1, "completed"), "b": (0, "failed")}


def test_steps_with_gaps(spark):
    rows = [
        ("1", "a", "l", "sent", None, 3, "pas", DAY), ("2", "a", "l", "drafted", None, None, "sdr", DAY), ("3", "a", "l", "sent", None, 0, "aida", DAY),
        ("4", "b", "l", "sent", None, -2, "pas", DAY), ("5", "c", "l", "sent", None, 2_000_000_000, "pas", DAY), ("6", "c", "l", "sent", None, 2, "pas", DAY),
    ]
    stats = funnel.step_stats(emails(spark, rows))
    small = sorted((r["campaign_id"], r["step"], r["drafted"], r["sent"], r["framework"], r["is_sequence"]) for r in stats.filter("campaign_id <> 'c'").collect())
    assert small == [("a", 1, 1, 0, "sdr", True), ("a", 2, 0, 0, None, True), ("a", 3, 0, 1, "pas", True), ("b", 1, 0, 0, None, False)]
    # A step far behind the others doesn't make a row for every number between.
    far = stats.filter("campaign_id = 'c'")
    assert far.count() == 2 + funnel.MOST_GAP + 1 and far.agg(F.sum("sent")).first()[0] == 2


def test_summary_of_all_campaigns(spark):
    campaigns = spark.createDataFrame([(str(i), f"n{i}", "ready", 0, DAY) for i in range(60)], "id string, name string, status string, leads_imported bigint, created_at timestamp")
    none = spark.createDataFrame([], EMAILS)
    assert funnel.campaign_summary(campaigns, none).count() == 50
    assert funnel.campaign_summary(campaigns, none, limit=None).count() == 60
