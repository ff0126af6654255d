"""Boards, forms, pages, feed, snapshots and sessions on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from heliograph.operators import boards, feed, ordering, pages, sessions, snapshots

DAY = datetime.datetime(2024, 1, 1)


def test_kanban_always_has_five_columns(spark):
    df = spark.createDataFrame([("todo",), ("blocked",), ("todo",)], "status string")
    got = [(r["status"], r["tasks"]) for r in boards.kanban_counts(df).orderBy("position").collect()]
    assert got == [("todo", 2), ("doing", 0), ("needs_input", 0), ("canceled", 0), ("done", 0)]
    assert boards.kanban_counts(df.limit(0)).count() == 5


def test_form_fields(spark):
    df = spark.sql("""SELECT 'f' AS slug, array(
        named_struct('label', 'Team Size!', 'name', CAST(NULL AS STRING), 'type', 'dropdown', 'required', true),
        named_struct('label', NULL, 'name', NULL, 'type', NULL, 'required', NULL)) AS fields""")
    got = [tuple(f) for f in boards.normalize_form_fields(df).first()["fields"]]
    assert got == [("team_size", "Team Size!", "text", True), ("field_2", "Field 2", "text", False)]


def test_submission_tables(spark):
    subs = spark.createDataFrame(
        [("1", "f", {"a": "x", "b": ""}, DAY), ("2", "f", {}, DAY + datetime.timedelta(1)), ("3", "g", {"a": "y"}, DAY)],
        "id string, form_slug string, data map<string,string>, received_at timestamp",
    )
    wide = boards.tabulate_form(subs, "f", [("a", "A"), ("b", "B")]).collect()
    assert [(r["id"], r["A"], r["B"]) for r in wide] == [("2", None, None), ("1", "x", None)]


def test_replies_become_tasks_once(spark):
    replies = spark.createDataFrame(
        [("r1", None, None, "t" * 300, None), ("r2", "a@b", "S", None, "c")],
        "id string, from string, subject string, text string, campaign_id string",
    )
    done = spark.createDataFrame([("r2",), (None,)], "reply_id string")
    got = boards.replies_to_tasks(replies, done).collect()
    assert [r["reply_id"] for r in got] == ["r1"]
    assert got[0]["title"] == "Reply from unknown"
    assert got[0]["description"] == "(no subject)\n\n" + "t" * 200 + "\n\nCampaign: —"
    assert boards.reply_preview(replies.withColumn("received_at", F.lit(DAY)), 5).first()["preview"] == "ttttt"


def test_page_forms(spark):
    site = spark.createDataFrame(
        [("p1", "x {{Form:Join-Us}} {{form:join-us}}", "other"), ("p2", "x", "join-us"), ("p3", "{{form:none}}", None), ("p4", None, None),
         ("p5", "{{form:my form.v2}}", None)],
        "slug string, html_body string, linked_form_slug string",
    )
    forms = spark.createDataFrame([("join-us", "J"), ("other", "O"), ("my form.v2", "M")], "slug string, title string")
    links = {tuple(r) for r in pages.link_pages_forms(site, forms).collect()}
    assert links == {("p1", "join-us"), ("p1", "other"), ("p2", "join-us"), ("p5", "my form.v2")}
    shown = {r["page_slug"]: (r["wanted_form"], r["form_title"]) for r in pages.resolve_page_form(site, forms).collect()}
    assert shown == {"p1": ("Join-Us", None), "p2": ("join-us", "J"), "p3": ("none", None), "p4": (None, None), "p5": (None, None)}
    named = spark.createDataFrame([("!!",), ("A b",)], "slug string")
    assert [r["slug"] for r in pages.normalize_page_slugs(named).collect()] == ["a-b"]


def feed_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, agent_id string, category string, summary string, details string, created_at timestamp")


def test_routes(spark):
    rows = [
        ("1", None, "email", "s", '{"campaign_id":"c","reply_id":"r"}', DAY), ("2", None, "email", "s", '{"reply_id":"r"}', DAY),
        ("3", None, "content", "Landing PAGE x", '{"slug":"s"}', DAY), ("4", None, "content", "Form", '{"slug":"s"}', DAY),
        ("5", None, "task", "s", '{"task_id":"t"}', DAY), ("6", None, "x", "s", '{"invitation_id":"i"}', DAY), ("7", None, "x", "s", None, DAY),
        ("8", None, "email", "s", '{"slug":"s"}', DAY),
    ]
    got = {r["id"]: r["route"] for r in feed.route_activity(feed_rows(spark, rows)).collect()}
    assert got == {"1": "/outreach/c", "2": "/inbox", "3": "/pages", "4": "/forms/s", "5": "/tasks", "6": "/voice", "7": None, "8": None}


def test_live_feed(spark):
    minute = datetime.timedelta(minutes=1)
    rows = [(str(i), None, "system", f"s{i}", None, DAY + i * minute) for i in range(30)] + [("29", None, "system", "older", None, DAY + 28 * minute)]
    df = feed_rows(spark, rows)
    live = feed.dedupe_feed(df).collect()
    assert len(live) == 20 == len({r["id"] for r in live}) and live[0]["summary"] == "s28"
    assert [r["summary"] for r in live if r["id"] == "29"] == ["older"]
    seen = spark.createDataFrame([("28",)], "id string")
    assert [r["id"] for r in feed.flag_new_entries(df, seen).collect()] == ["29"]
    assert feed.flag_new_entries(df, spark.createDataFrame([("29",)], "id string")).count() == 0
    assert feed.remembered_ids(df).count() == 5
    now = DAY + 29 * minute
    assert feed.feed_active(df, F.lit(now + datetime.timedelta(seconds=59))).first()["active"]
    assert not feed.feed_active(df, F.lit(now + datetime.timedelta(seconds=60))).first()["active"]
    assert not feed.feed_active(df.limit(0), F.lit(now)).first()["active"]
    assert df.select(feed.category_or_default(F.lit("odd"))).first()[0] == "system"


def test_all_feed_sources(spark):
    campaigns = spark.createDataFrame([("c", "Camp", "q", DAY)], "id string, name string, query string, created_at timestamp")
    run = spark.createDataFrame(
        [("1", "c", "Camp", "run", 4, 5, 1, 3, DAY)],
        "id string, campaign_id string, name string, apify_run_id string, sent int, total int, errors int, generated int, at timestamp",
    )
    tasks = spark.createDataFrame([("t", "Reply from a", "g", "done", "r", DAY)], "id string, title string, assignee_id string, status string, reply_id string, created_at timestamp").withColumn("updated_at", F.col("created_at"))
    update = spark.createDataFrame([("u", "s", None, ["title", "theme"], DAY), ("v", "s", "T", [], DAY)], "id string, slug string, title string, changed array<string>, updated_at timestamp")
    both = feed.activity_feed(
        feed.from_new_campaigns(campaigns),
        feed.from_scrape_starts(run.withColumn("started_at", F.col("at"))),
        feed.from_scrape_imports(run.withColumn("imported", F.lit(9)).withColumn("finished_at", F.col("at"))),
        feed.from_draft_batches(run.withColumn("finished_at", F.col("at"))),
        feed.from_send_runs(run.withColumn("finished_at", F.col("at"))),
        feed.from_task_moves(tasks),
        feed.from_converted_replies(tasks),
        feed.from_page_updates(update),
        feed.from_deleted_agents(spark.createDataFrame([("g", DAY)], "id string, deleted_at timestamp")),
        feed.from_sessions(spark.createDataFrame([("s", "Voice session (3s): hi", DAY)], "id string, summary string, ended_at timestamp")),
    )
    got = {r["id"]: (r["category"], r["summary"], r["details"]) for r in both.collect()}
    assert got["scrape-1"] == ("research", 'Apify scrape complete: 9 leads imported for "Camp"', '{"campaign_id":"c","imported":9}')
    assert got["drafts-1"][1] == 'Drafted 3 emails for "Camp"' and got["send-1"][1] == 'Sent 4 of 5 emails for "Camp"'
    assert got["move-t"][1] == 'Task "Reply from a" → done' and got["convert-t"][:2] == ("decision", "Reply from a converted to task")
    assert got["page-update-u"][1] == 'Landing page "s" updated (title, theme)' and got["page-update-v"][1].endswith("(no fields)")
    assert got["agent-deleted-g"][1] == "Agent g deleted" and got["session-s"][2] == '{"session_id":"s"}'
    assert got["scrape-start-1"][1] == 'Apify run started for "Camp"' and got["campaign-c"][2] == '{"campaign_id":"c","query":"q"}'


def test_emoji(spark):
    rows = [("1", "g", "task", "s", None, DAY), ("2", None, "task", "s", None, DAY), ("3", "zz", "task", "s", None, DAY)]
    agents = spark.createDataFrame([("g", "🤖")], "id string, emoji string")
    got = {r["id"]: r["emoji"] for r in feed.activity_with_agent(feed_rows(spark, rows), agents).collect()}
    assert got == {"1": "🤖", "2": "⚡", "3": "⚡"}


def test_snapshot(spark):
    rows = [
        ("a", 1, "put", "t1", "x"), ("a", 2, "patch", None, "y"), ("a", 3, "patch", "t3", None),
        ("b", 1, "put", "t", "x"), ("b", 2, "delete", None, None), ("b", 3, "patch", "late", None),
        ("c", 1, "patch", "early", "e"), ("c", 2, "put", "t2", None), ("c", 3, "patch", None, None),
        ("d", 1, "delete", None, None), ("d", 2, "put", "again", "z"), ("e", 1, "patch", "only", None),
    ]
    df = spark.createDataFrame(rows, "id string, seq int, op string, title string, status string")
    got = {r["id"]: (r["title"], r["status"], r["seq"]) for r in snapshots.latest_snapshot(df, ["id"], ["title", "status"], ["seq"]).collect()}
    assert got == {"a": ("t3", "y", 3), "c": ("t2", None, 3), "d": ("again", "z", 2)}


def test_presence(spark):
    agents = spark.createDataFrame([("1", "idle", None), ("2", "error", DAY)], "id string, status string, last_heartbeat timestamp")
    beats = spark.createDataFrame([("1", DAY), ("1", DAY + datetime.timedelta(1)), ("9", DAY)], "agent_id string, at timestamp")
    got = {r["id"]: (r["status"], r["last_heartbeat"]) for r in snapshots.agent_presence(agents, beats).collect()}
    assert got == {"1": ("online", DAY + datetime.timedelta(1)), "2": ("error", DAY)}


def test_transcript(spark):
    rows = [("s", 0, "agent", "a", False), ("s", 1, "agent", "ab", True), ("s", 2, "agent", "c", False),
            ("t", 0, "user", " \n", True), ("t", 5, "user", "x", None), ("t", 9, "user", "xy", False), ("t", 11, "agent", "z", False)]
    df = spark.createDataFrame(rows, "session_id string, seq bigint, role string, text string, final boolean")
    for block in (1, 2, 3, 100):
        got = sorted((r["session_id"], r["seq"], r["text"]) for r in sessions.fold_transcript(df, block).collect())
        assert got == [("s", 1, "ab"), ("s", 2, "c"), ("t", 9, "xy"), ("t", 11, "z")]


def test_tool_calls(spark):
    rows = [("s", 1, "f", "{}", None, None), ("s", 2, "f", "{}", "r", None), ("s", 3, "f", "{}", None, None),
            ("s", 4, "f", "{}", None, "e"), ("s", 5, "g", None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, seq int, name string, params string, result string, error string")
    got = sorted(tuple(r)[1:] for r in sessions.merge_tool_calls(df).collect())
    assert got == [(1, "f", "{}", None, "e"), (5, "g", None, None, None)]


def test_session_lines(spark):
    df = spark.createDataFrame(
        [("1", DAY, DAY + datetime.timedelta(seconds=62.5), [("agent", "hi", True), ("user", "u" * 90, True)], [("f", "{}", None, None)], None),
         ("2", DAY, DAY + datetime.timedelta(seconds=2), [], None, "i")],
        "id string, started_at timestamp, ended_at timestamp, transcripts array<struct<role:string,text:string,final:boolean>>,"
        " tools array<struct<name:string,params:string,result:string,error:string>>, invitation_id string",
    )
    got = {r["id"]: (r["duration_seconds"], r["duration"], r["turns"], r["tool_calls"], r["summary"]) for r in sessions.session_summary(df).collect()}
    assert got["1"] == (63, "1m 3s", 2, 1, "Voice session (63s): " + "u" * 80)
    assert got["2"] == (2, "2s", 0, 0, "Voice session (2s): no user input")


def test_lists(spark):
    rows = [(str(i), "a" if i % 3 else "b", DAY + datetime.timedelta(i)) for i in range(9)] + [("n", "a", None)]
    df = spark.createDataFrame(rows, "id string, campaign_id string, created_at timestamp")
    assert [r["id"] for r in ordering.newest_first(df, "created_at", 2).collect()] == ["8", "7"]
    assert ordering.newest_first(df, "created_at", None).collect()[-1]["id"] == "n"
    top = ordering.newest_per_group(df, "campaign_id", 2, "created_at").collect()
    assert sorted(r["id"] for r in top) == ["3", "6", "7", "8"]
