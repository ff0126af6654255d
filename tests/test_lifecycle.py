"""Status folding against a sequential reading of the rules."""

import datetime
import random

import pytest

from heliograph.operators import lifecycle

DDL = "email_id string, campaign_id string, at timestamp, event_id string, status string, kind string"
START = datetime.datetime(2024, 1, 1)
RANK = {"drafted": 0, "sent": 1, "delivered": 2, "clicked": 3, "replied": 4}
NEGATIVE = {"bounced", "complained", "failed"}


def kind_of(status):
    return {"clicked": "click", "replied": "reply"}.get(status, "provider")


def frame(spark, lists):
    """Lists of (status, kind) per e-mail, a minute apart."""
    rows = []
    for key, steps in lists.items():
        for i, (status, kind) in enumerate(steps):
            rows.append((key, "c" + key[:1], START + datetime.timedelta(minutes=7 * i), f"{i:05d}", status, kind))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DDL)


def one_by_one(steps):
    """(final status, which events took effect)."""
    current, applied = "drafted", []
    for status, kind in steps:
        if kind == "ack" or status in NEGATIVE:
            takes = True
        else:
            takes = RANK.get(status, 0) >= RANK.get(current, 0)
        applied.append(takes)
        if takes:
            current = status
    return current, applied


@pytest.mark.parametrize(
    "statuses, final",
    [
        (["bounced", "sent"], "sent"),
        (["delivered", "sent"], "delivered"),
        (["replied", "clicked"], "replied"),
        (["bounced", "clicked"], "clicked"),
        (["replied", "bounced"], "bounced"),
        (["complained"], "complained"),
    ],
)
def test_known_cases(spark, statuses, final):
    steps = [(s, kind_of(s)) for s in statuses]
    assert one_by_one(steps)[0] == final
    assert lifecycle.fold_email_status(frame(spark, {"e": steps})).first()["status"] == final


def test_acknowledgement_resets(spark):
    steps = [("delivered", "provider"), ("sent", "ack"), ("sent", "provider")]
    assert lifecycle.fold_email_status(frame(spark, {"e": steps})).first()["status"] == "sent"


@pytest.fixture(scope="module")
def random_lists():
    rng = random.Random(7)
    choices = [("sent", "ack")] + [(s, kind_of(s)) for s in ("sent", "delivered", "clicked", "replied", "bounced", "complained", "failed")]
    lists = {f"{i}": [rng.choice(choices) for _ in range(rng.randint(1, 14))] for i in range(400)}
    lists["hot"] = [rng.choice(choices) for _ in range(3000)]
    return lists


def test_fold_equals_sequential(spark, random_lists):
    got = {r["email_id"]: r for r in lifecycle.fold_email_status(frame(spark, random_lists)).collect()}
    for key, steps in random_lists.items():
        assert got[key]["status"] == one_by_one(steps)[0]
        assert got[key]["click_count"] == sum(kind == "click" for _, kind in steps)


@pytest.mark.parametrize("block_seconds", [60, 3600, 10**9])
def test_applied_equals_sequential(spark, random_lists, block_seconds):
    marked = lifecycle.mark_applied(frame(spark, random_lists), block_seconds).collect()
    assert len(marked) == sum(map(len, random_lists.values()))
    expected = {key: one_by_one(steps)[1] for key, steps in random_lists.items()}
    for r in marked:
        assert r["applied"] == expected[r["email_id"]][int(r["event_id"])]


def test_status_times_keep_the_last_effect(spark):
    steps = [("delivered", "provider"), ("clicked", "click"), ("delivered", "provider")]
    r = lifecycle.status_times(frame(spark, {"e": steps})).first()
    assert r["delivered_at"] == START and r["clicked_at"] == START + datetime.timedelta(minutes=7)
    assert r["bounced_at"] is None


def test_counters_count_events(spark):
    steps = [("delivered", "provider"), ("delivered", "provider"), ("replied", "reply"), ("clicked", "click"),
             ("delivered", "provider"), ("complained", "provider"), ("bounced", "provider")]
    marked = lifecycle.mark_applied(frame(spark, {"e": steps}))
    r = lifecycle.event_counters(marked).first()
    assert (r["emails_delivered"], r["emails_bounced"], r["emails_clicked"], r["emails_replied"]) == (2, 1, 1, 1)
