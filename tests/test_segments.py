import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventsieve.operators import visitors


def events(seed, n=900):
    """Events of a few visitors, one of whom has two thirds of them, with ties in time, null visitors and gaps."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        who = 1 if draw.random() < 0.67 else draw.choice([2, 3, 4, None])
        at = datetime.datetime(2026, 9, 1) + datetime.timedelta(hours=draw.randint(0, 2000))
        campaign = {"utm_source": draw.choice("abc")} if draw.random() < 0.02 else {} if draw.random() < 0.9 else None
        rows.append((i, who, at, campaign, draw.choice(["", "", "", None, "x.org", "y.org"]), draw.random() < 0.2, i * 10, i * 100))
    return rows


SCHEMA = "event_id long, who long, ts timestamp, campaign map<string,string>, referrer string, shut boolean, s long, part long"


@pytest.fixture(scope="module")
def hot(spark):
    # small ranges would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(events(5), SCHEMA).repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def in_order(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by.setdefault(r.who, []).append(r)
    return by


def test_attribution_of_a_hot_visitor(hot):
    out = visitors.attributed(hot, "who", ["ts", "event_id"], "campaign", "referrer")
    assert out.columns == [*hot.columns, "last_touch", "first_referrer"]
    found = {r.event_id: (r.last_touch, r.first_referrer, r.part, r.s) for r in out.collect()}
    expected = {}
    for rows in in_order(hot.collect()).values():
        touch = first = None
        for r in rows:
            touch, first = r.campaign or touch, first or r.referrer or None
            expected[r.event_id] = (touch, first, r.part, r.s)
    assert found == expected


@pytest.mark.parametrize(("idle", "shut"), [(20, 2), (5, 1), (1, 0)])
def test_sessions_of_a_hot_visitor(hot, idle, shut):
    out = visitors.sessions(hot, "who", "ts", F.col("shut"), "event_id", idle, shut)
    assert out.columns == [*hot.columns, "session"]
    found = {r.event_id: (r.session, r.s, r.part) for r in out.collect()}
    expected = {}
    for rows in in_order(hot.collect()).values():
        session, before = 0, None
        for r in rows:
            gap = (r.ts - before.ts).total_seconds() / 3600 if before else None
            session += before is None or gap > idle or (before.shut and gap > shut)
            expected[r.event_id], before = (session, r.s, r.part), r
    assert found == expected


def test_no_task_holds_a_hot_visitor(hot):
    cut = visitors.Segments(hot, "who", ["ts", "event_id"])
    sizes = [r["count"] for r in cut.rows.groupBy(cut.part).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * hot.count()
    assert cut.rows.where("who = 1").select(cut.part).distinct().count() >= 3


def test_empty_and_single_rows(spark, hot):
    none = hot.where("false")
    assert visitors.attributed(none, "who", ["ts"], "campaign", "referrer").count() == 0
    assert visitors.sessions(none, "who", "ts", F.col("shut"), "event_id").count() == 0
    one = visitors.sessions(hot.where("event_id = 3"), "who", "ts", F.col("shut"), "event_id").collect()
    assert [r.session for r in one] == [1]


def test_capped_log_and_quarantine_keep_columns_of_any_name(hot):
    latest = visitors.capped_log(hot.withColumn("n", F.lit(7)).withColumn("s", F.lit(8)), "who", "event_id", 2).collect()
    assert len(latest) == 2 * 5 and {(r.n, r.s) for r in latest} == {(7, 8)}
    leads = hot.select("event_id", F.lit("mine").alias("errors"), F.lit("").alias("trap"))
    wrong = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    valid, quarantine = visitors.checked_leads(leads, wrong, "trap")
    assert valid.columns == ["event_id", "errors"] and valid.first()["errors"] == "mine"
    assert quarantine.columns == ["event_id", "errors", "errors_"] and quarantine.first()["errors_"] == ["bad"]
