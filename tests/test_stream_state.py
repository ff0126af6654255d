"""State of streams in buckets, and the views that micro-batches leave."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import correlation, lifecycle
from heliograph.sources.files import Commits
from heliograph.streaming import jobs, sinks
from heliograph.streaming.state import KeyedState

START = datetime.datetime(2024, 1, 1)
COUNTS = "k string, n bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def folders(path, name):
    return {os.path.join(d, s) for d, subs, _ in os.walk(path) for s in subs if s.startswith(f"{name}=")}


def summed(before, batch):
    return before.unionByName(batch).groupBy("k").agg(F.sum("n").alias("n"))


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    table = KeyedState(spark, str(tmp_path), COUNTS, "k", 16)
    keys = [str(i) for i in range(200)]
    first = spark.createDataFrame([(k, 1) for k in keys], COUNTS)
    table.update(first, [first.select("k")], 0, summed)
    one = spark.createDataFrame([("7", 5), ("7", 1)], COUNTS)
    touched = table.touched(one.select("k"))
    assert len(touched) == 1
    before = table.update(one, [one.select("k")], 1, summed)
    assert {f.split("/bucket=")[1].split("/")[0] for f in before.inputFiles()} == {str(touched[0])}
    assert all("version=0" in f for f in before.inputFiles())
    assert folders(f"{tmp_path}/version=1", "bucket") == {f"{tmp_path}/version=1/bucket={touched[0]}"}
    assert rows(table.read()) == sorted((k, 7 if k == "7" else 1) for k in keys)
    # A batch that runs again starts from the one before it.
    table.update(one, [one.select("k")], 1, summed)
    assert rows(table.read()) == sorted((k, 7 if k == "7" else 1) for k in keys)
    # The table knows its number of buckets.
    assert KeyedState(spark, str(tmp_path), COUNTS, "k").buckets == 16


def test_files_do_not_pile_up(spark, tmp_path):
    table = KeyedState(spark, str(tmp_path), COUNTS, "k", 2)
    for i in range(6):
        batch = spark.createDataFrame([(str(k), 1) for k in range(8)], COUNTS)
        table.update(batch, [batch.select("k")], i, summed)
    assert rows(table.read()) == [(str(k), 6) for k in range(8)]
    # The last two versions of both buckets are there; nothing else.
    assert len(folders(tmp_path, "bucket")) == 4 and len(folders(tmp_path, "version")) == 2
    assert Commits(spark, str(tmp_path)).numbers() == [4, 5]


def test_a_batch_written_by_half_is_invisible(spark, tmp_path):
    table = KeyedState(spark, str(tmp_path), COUNTS, "k", 2)
    batch = spark.createDataFrame([("a", 1)], COUNTS)
    table.update(batch, [batch.select("k")], 0, summed)
    spark.createDataFrame([("a", 99)], COUNTS).write.parquet(f"{tmp_path}/version=1/bucket={table.touched(batch.select('k'))[0]}")
    assert rows(table.read()) == [("a", 1)]
    assert rows(KeyedState(spark, str(tmp_path / "none"), COUNTS, "k").read()) == []


MAIL = "id string, campaign_id string, lead_id string, created_at timestamp, agentmail_message_id string, agentmail_thread_id string"


def test_calls_find_emails_without_a_scan(spark, tmp_path):
    rng = random.Random(5)
    mails = [(str(i), f"c{i % 3}", "l", START + datetime.timedelta(hours=rng.randrange(50)), f"m{i % 70}" if i % 5 else None, f"t{i % 11}") for i in range(300)]
    index = jobs.EmailIndex(spark, str(tmp_path), 32)
    for n in range(3):
        index.add(spark.createDataFrame(mails[n * 100 : n * 100 + 100], MAIL), n)
    index.add(spark.createDataFrame(mails[200:], MAIL), 2)
    emails = spark.createDataFrame(mails, MAIL)
    events = spark.createDataFrame([(str(i), rng.choice([None, "", "m3", "m9", "mx"]), rng.choice([None, "t4", "tx"])) for i in range(60)], "id string, message_id string, thread_id string")
    found = index.match_events(events)
    assert rows(found) == rows(correlation.correlate_events(events, emails))
    replies = events.select("id", F.col("thread_id").alias("agentmail_thread_id"))
    assert rows(index.match_replies(replies)) == rows(correlation.correlate_replies(replies, emails))
    # Of 64 buckets only those of the ids at hand are opened.
    opened = {f.split(str(tmp_path))[1].rsplit("/", 1)[0] for f in found.inputFiles() if str(tmp_path) in f}
    assert 2 <= len(opened) <= 6


def test_status_states_merge(spark, tmp_path):
    rng = random.Random(6)
    kinds = [("sent", "ack"), ("delivered", "provider"), ("bounced", "provider"), ("clicked", "click"), ("replied", "reply")]
    events = [(str(rng.randrange(30)), START + datetime.timedelta(minutes=rng.randrange(500)), str(i), *rng.choice(kinds)) for i in range(600)]
    ddl = "email_id string, at timestamp, event_id string, status string, kind string"
    states, update = jobs.status_keeper(spark, str(tmp_path), lambda batch: batch, 8)
    for n in range(4):
        update(spark.createDataFrame(events[n::4], ddl), n)
    update(spark.createDataFrame(events[3::4], ddl), 3)
    assert rows(lifecycle.status_of(states.read())) == rows(lifecycle.fold_email_status(spark.createDataFrame(events, ddl)))


@pytest.fixture
def many_files(spark, tmp_path):
    source = tmp_path / "source"
    for i in range(40):
        spark.createDataFrame([(f"k{i % 7}", 1)], COUNTS).coalesce(1).write.parquet(f"{source}/f{i:03d}")
    return spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")


def test_a_view_stays_small(spark, tmp_path, many_files):
    total = lambda r: sinks.summed_per_key(r, ["k"])
    path = f"{tmp_path}/view"
    sinks.stream_sink(many_files, path, f"{tmp_path}/c", merge=total, merged_after=8).awaitTermination()
    view = sinks.read_batches(spark, path)
    assert rows(total(view)) == [(f"k{i}", len(range(i, 40, 7))) for i in range(7)]
    # One merged table and fewer than eight batches; the other folders are what a repetition starts from.
    opened = {f.split("/view/")[1].split("/")[0] for f in view.inputFiles()}
    assert len(opened) <= 8 and sum(f.startswith("upto") for f in opened) == 1
    assert len(folders(path, "batch_id")) + len(folders(path, "upto")) <= 18
    # A batch that isn't committed isn't read, nor is one of other columns in the way.
    spark.createDataFrame([("k0", 1000, 1)], "k string, n bigint, x int").write.parquet(f"{path}/batch_id=40")
    assert rows(total(sinks.read_batches(spark, path))) == rows(total(view))


def test_a_repeated_batch_of_a_view(spark, tmp_path, many_files):
    total = lambda r: sinks.summed_per_key(r, ["k"])
    path, checkpoint = f"{tmp_path}/view", tmp_path / "c"
    start = lambda: sinks.stream_sink(many_files, path, str(checkpoint), merge=total, merged_after=8).awaitTermination()
    start()
    first = rows(total(sinks.read_batches(spark, path)))
    # As if the driver had died right before the last batch was known to be done: it is one that merges.
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    assert last % 8 == 7
    for p in (checkpoint / "commits").glob(f"*{last}*"):
        p.unlink()
    start()
    assert rows(total(sinks.read_batches(spark, path))) == first


def test_probes_and_calls_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    at = lambda s: START + datetime.timedelta(seconds=s)
    calls = [("call", f"w{rng.randrange(3)}", at(rng.randrange(40_000)), None) for _ in range(3000)]
    probes = [("probe", f"w{rng.randrange(3)}", at(rng.randrange(40_000)), f"p{i}") for i in range(300)]
    ddl = "kind string, webhook_id string, at timestamp, probe_id string"
    whole = calls + probes
    rng.shuffle(whole)
    counter = jobs.ArrivalCounter(spark, str(tmp_path))
    parts = [counter(spark.createDataFrame(whole[n::4], ddl), n).collect() for n in range(4)]
    again = counter(spark.createDataFrame(whole[3::4], ddl), 3).collect()
    assert sorted(again) == sorted(parts[3])
    got = {}
    for r in (r for part in parts for r in part):
        got[r.probe_id] = got.get(r.probe_id, 0) + r.new_events
    want = {p: sum(w == v and s <= t < s + datetime.timedelta(seconds=15) for _, v, t, _ in calls) for _, w, s, p in probes}
    assert got == {p: n for p, n in want.items() if n}


def test_probes_out_of_range_are_not_read(spark, tmp_path):
    ddl = "kind string, webhook_id string, at timestamp, probe_id string"
    day = datetime.timedelta(days=1)
    counter = jobs.ArrivalCounter(spark, str(tmp_path))
    counter(spark.createDataFrame([("probe", "w", START + i * day, f"p{i}") for i in range(20)], ddl), 0)
    call = spark.createDataFrame([("call", "w", START + 3 * day + datetime.timedelta(seconds=5), None)], ddl)
    opened = counter._near(counter.probes, call, "call", -15, 1).inputFiles()
    assert len({f.split("span=")[1].split("/")[0] for f in opened}) == 1
    assert rows(counter(call, 1)) == [("p3", 1)]


FEED = "id string, agent_id string, category string, summary string, details string, created_at timestamp"


def plain_live(batches):
    """The list, the flashed ids and the remembered ones after every batch, as a client keeps them."""
    whole, seen, flashed = {}, set(), set()
    for batch in batches:
        for r in batch:
            whole.setdefault(r[0], r)
        top = sorted(whole.values(), key=lambda r: (-r[5].timestamp(), r[0]))[:20]
        if top and top[0][0] not in seen:
            flashed.add(top[0][0])
            seen |= {r[0] for r in top[:5]}
        yield [(r[0], r[0] in flashed) for r in top]


def test_live_feed_over_batches(spark, tmp_path):
    rng = random.Random(8)
    entries = [(f"e{i}", None, "system", f"s{i}", None, START + datetime.timedelta(minutes=rng.randrange(300))) for i in range(200)]
    batches = [entries[n : n + 25] + rng.sample(entries[: n + 25], 3) for n in range(0, 200, 25)] + [[]]
    live = jobs.LiveFeed(spark, str(tmp_path))
    for n, want in enumerate(plain_live(batches)):
        got = live(spark.createDataFrame(batches[n], FEED), n).orderBy("position").collect()
        assert [(r.id, r.flashed) for r in got] == want
    again = live(spark.createDataFrame(batches[-1], FEED), len(batches) - 1).orderBy("position").collect()
    assert [(r.id, r.flashed) for r in again] == want
    # The state is the list.
    assert len(folders(tmp_path, "before")) == 2 and spark.read.parquet(f"{tmp_path}/before={len(batches)}").count() == 20


def test_seen_ids_over_many_batches(spark, tmp_path):
    from heliograph.streaming.state import SeenIds

    rng = random.Random(9)
    first = jobs.redelivery_filter(spark, str(tmp_path), fanout=3)
    ddl, seen, kept = "id string, event_id string, received_at timestamp", set(), []
    for n in range(10):
        # Some new events, some of any earlier batch, one within the batch twice, one without an event.
        ids = [f"e{n}-{i}" for i in range(6)] + [f"e{rng.randrange(n + 1)}-{rng.randrange(6)}" for _ in range(4)]
        batch = [(f"c{n}-{i}", e, START - datetime.timedelta(hours=rng.randrange(90))) for i, e in enumerate([*ids, ids[0], None])]
        df = spark.createDataFrame(batch, ddl)
        got = {(r.event_id, r.event_id is None and r.id) for r in first(df, n).collect()}
        want = {(e, e is None and i) for i, e, _ in batch if e is None or e not in seen}
        assert got == want
        if n in (4, 8):
            assert {(r.event_id, r.event_id is None and r.id) for r in first(df, n).collect()} == want
        seen |= {e for _, e, _ in batch}
        kept += want
    assert len(kept) == len(set(kept)) == 70
    segments = SeenIds(spark, str(tmp_path)).segments()
    assert len(segments) <= 6 and {s["level"] for s in segments} >= {0, 2}
    # What no batch names any more is gone.
    assert len(os.listdir(tmp_path / "list")) <= 2 * len(segments) + 3
