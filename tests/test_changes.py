"""Changes against the state they met, merged snapshots, and what deletions leave behind."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import correlation, snapshots
from heliograph.streaming import jobs

START = datetime.datetime(2024, 1, 1)
DDL = "id string, at timestamp, seq bigint, op string, title string, status string, assignee_id string"


def log(n=400, hot=True, seed=1):
    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() < 0.6 else None
    out = []
    for i in range(n):
        key = "hot" if hot and rng.random() < 0.4 else f"k{rng.randrange(12)}"
        op = rng.choice(["put", "patch", "patch", "patch", "delete"])
        out.append((key, START + datetime.timedelta(minutes=rng.randrange(20_000)), i, op, maybe(f"t{i}"), maybe(f"s{i}"), maybe(f"a{i % 3}")))
    return out


def replayed(changes):
    """Each change with the state before it, one after the other; and the last state."""
    state, met = {}, {}
    for key, at, seq, op, *values in sorted(changes, key=lambda c: (c[1], c[2])):
        before = state.get(key)
        met[seq] = before
        if op == "put":
            state[key] = values
        elif op == "delete":
            state.pop(key, None)
        elif before is not None:
            state[key] = [v if v is not None else b for v, b in zip(values, before)]
    return met, state


@pytest.mark.parametrize("most", [65_536, 5])
def test_state_before_each_change(spark, most):
    changes = log()
    got = snapshots.with_state_before(spark.createDataFrame(changes, DDL), "id", ["title", "status", "assignee_id"], ["at", "seq"], block_rows=most)
    met, _ = replayed(changes)
    found = {r.seq: (r.existed, r.before and [*r.before]) for r in got.collect()}
    assert found == {seq: (b is not None, b) for seq, b in met.items()}
    # A hot entity is cut into blocks.
    assert got.limit(0).count() == 0 and len(found) == len(changes)


def test_moves_and_updates(spark):
    changes = log(200, seed=2)
    df = spark.createDataFrame(changes, DDL)
    met, _ = replayed(changes)
    want = sorted((f"{k}-{seq}", met[seq][0], status, met[seq][2]) for k, _, seq, op, _, status, _ in changes if op == "patch" and met[seq] and status)
    got = sorted(((r.id, r.title, r.status, r.assignee_id) for r in snapshots.task_moves(df).collect()))
    assert sorted(got, key=str) == sorted(want, key=str)
    pages = df.select(F.col("id").alias("slug"), "at", "seq", "op", "title", F.col("status").alias("theme"))
    want = {f"{k}-{seq}": (met[seq][0], [n for n, v in (("title", t), ("theme", s)) if v is not None]) for k, _, seq, op, t, s, _ in changes if op == "patch" and met[seq]}
    assert {r.id: (r.title, r.changed) for r in snapshots.page_updates(pages, ["title", "theme"]).collect()} == want
    assert snapshots.deletions(df).count() == sum(c[3] == "delete" for c in changes)


def test_merged_snapshots(spark, tmp_path):
    changes, fields, order = log(500, seed=3), ["title", "status", "assignee_id"], ["at", "seq"]
    df = spark.createDataFrame(changes, DDL)
    _, last = replayed(changes)
    whole = {r.id: [r.title, r.status, r.assignee_id] for r in snapshots.latest_snapshot(df, ["id"], fields, order).collect()}
    assert whole == last
    states, update = jobs.snapshot_keeper(spark, str(tmp_path), df, "id", fields, order, 4)
    # Parts in any order, one of them twice.
    for n, part in enumerate((2, 0, 1, 1)):
        update(df.filter(F.col("seq") % 3 == part), n)
    merged = snapshots.snapshot_of(states.read(), ["id"], fields, order)
    assert {r.id: [r.title, r.status, r.assignee_id] for r in merged.collect()} == last
    # Merging is associative: (a + b) + c = a + (b + c).
    a, b, c = (snapshots.snapshot_state(df.filter(F.col("seq") % 3 == n), ["id"], fields, order) for n in range(3))
    merge = lambda x, y: snapshots.merge_snapshot_states(x, y, ["id"])
    left, right = merge(merge(a, b), c), merge(a, merge(b, c))
    assert left.exceptAll(right.select(left.columns)).count() == 0


def test_sweep_on_all_levels(spark):
    rng = random.Random(4)
    ids = {k: [f"{k}{i}" for i in range(40)] for k in ("campaigns", "leads", "emails", "replies", "clicks", "webhooks", "webhook_events", "agents", "agent_keys")}
    parents = {}
    for child, key, parent in correlation.CHILD_LINKS:
        pick = lambda: rng.choice([None, "", *rng.choices(ids[parent], k=20)])
        parents[child, key] = {i: "campaigns0" if parent == "campaigns" and rng.random() < 0.3 else pick() for i in ids[child]}
    gone = {k: set(rng.sample(ids[k], 8)) for k in ("campaigns", "leads", "webhooks", "agents")}
    tables = {}
    for kind, own in ids.items():
        keys = [k for c, k, _ in correlation.CHILD_LINKS if c == kind]
        rows = [(i, *(parents[kind, k][i] for k in keys)) for i in own if i not in gone.get(kind, ())]
        tables[kind] = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("id", *keys)))
    want, out = {k: set(ids[k]) - gone.get(k, set()) for k in ids}, set()
    for child in dict.fromkeys(c for c, _, _ in correlation.CHILD_LINKS):
        for i in sorted(want[child]):
            for c, key, parent in correlation.CHILD_LINKS:
                if c == child and parents[c, key][i] and parents[c, key][i] not in want[parent]:
                    out.add((child, i, parent))
                    break
        want[child] -= {i for k, i, _ in out if k == child}
    assert {tuple(r) for r in correlation.orphan_sweep(tables).collect()} == out and len({k for k, _, _ in out}) == 6
