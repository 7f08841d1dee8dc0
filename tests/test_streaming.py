import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventsieve.operators import publish, visitors
from eventsieve.streaming import jobs
from tests.test_similarity import PRINT, cards


def stream(spark, folder, table, schema, parts):
    """A file stream that reads the parts of table one by one."""
    for i, condition in enumerate(parts):
        table.where(condition).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_published_stream_equals_the_batch_loop(spark, tmp_path):
    rows = [(*r, r[0], r[0] % 2) for r in cards(3, 16)]
    items = spark.createDataFrame(rows, f"{PRINT}, pos long, issue long")
    batch = publish.publish_issues(items, "issue", [F.col("pos")])
    history = str(tmp_path / "history")
    source = stream(spark, tmp_path / "in", items, items.schema, ["issue = 0", "issue = 1"])
    for _ in range(2):  # a second run from the start leaves the same table
        query = jobs.publish_stream(source, history, [F.col("pos")], look_back_days=None).trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / f"state{_}")).start().awaitTermination()
        found = spark.read.parquet(history)
        assert {(r.issue, r.id) for r in found.collect()} == {(r.issue, r.id) for r in batch.collect()}


def test_retries(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [("a", i, at + datetime.timedelta(hours=h), c) for i, (h, c) in enumerate([(0, False), (1, True), (14, False), (15, False)])]
    rows += [rows[0]]
    schema = "visitor string, mid int, ts timestamp, closed boolean"
    table = spark.createDataFrame(rows, schema)
    source = stream(spark, tmp_path / "in", table, table.schema, ["ts < '2026-01-01 10:00'", "ts >= '2026-01-01 10:00'"])
    once = jobs.retries_dropped(source, ["visitor", "mid"], "ts")
    query = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 4


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def drained(spark, result, name):
    query = result.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), query


def test_late_events_get_the_sessions_of_the_batch(spark, tmp_path, rocks):
    draw = random.Random(5)
    at = datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(300):
        who = draw.choice(["a", "a", "a", "b", "c", None])
        rows.append((who, i, at + datetime.timedelta(minutes=draw.randrange(0, 20_000), microseconds=draw.randrange(3)), draw.random() < 0.3))
    rows += [("a", 1000 + i, rows[i][2], True) for i in range(5)] + [("d", 900, None, False)]
    schema = "visitor string, mid int, ts timestamp, closed boolean"
    table = spark.createDataFrame(rows, schema)
    end = spark.createDataFrame([("end", 0, at + datetime.timedelta(days=400), False)], schema)
    batch = visitors.sessions(table.where("ts is not null"), "visitor", "ts", F.col("closed"), "mid", 3, 1)
    expected = sorted((str(r.visitor), r.mid, r.ts, r.session) for r in batch.collect())
    # parts overlap in time by two days: part i holds what comes from day 2i to day 2i + 4, split by chance
    day = "floor((unix_timestamp(ts) - unix_timestamp(timestamp'2026-01-01')) / 86400 / 2) + mid % 2"
    parts = [f"{day} = {i}" for i in range(9)] + ["ts is null"]
    source = stream(spark, tmp_path / "in", table.union(end), schema, [*parts, "visitor = 'end'"])
    numbered = jobs.sessions_stream(source, "visitor", "ts", "closed", "mid", "5 days", 3, 1)
    found, _ = drained(spark, numbered, "numbered")
    assert sorted((str(r.visitor), r.tie, r.ts, r.session) for r in found.where("visitor is null or visitor <> 'end'").collect()) == expected


def test_a_visitor_is_forgotten(spark, tmp_path, rocks):
    at = datetime.datetime(2026, 1, 1)
    hours = [0, 10, 400, 1000, 2000]
    rows = [("a" if h != 400 else "b", i, at + datetime.timedelta(hours=h), False) for i, h in enumerate(hours)]
    schema = "visitor string, mid int, ts timestamp, closed boolean"
    source = stream(spark, tmp_path / "in", spark.createDataFrame(rows, schema), schema, [f"mid = {i}" for i in range(len(rows))])
    found, query = drained(spark, jobs.sessions_stream(source, "visitor", "ts", "closed", "mid", "1 hour", 5, 5, 300), "forgotten")
    assert [(r.tie, r.session) for r in found.orderBy("tie").collect()] == [(0, 1), (1, 2), (2, 1), (3, 1)]


def test_deliveries_equal_the_batch(spark, tmp_path):
    draw = random.Random(8)
    at = datetime.datetime(2026, 1, 1)
    leads = [(i, at + datetime.timedelta(minutes=20 * i)) for i in range(200)]
    attempts = []
    for i, sent in leads:
        for _ in range(draw.randrange(0, 5)):
            attempts.append((i, sent + datetime.timedelta(minutes=draw.randrange(-60, 600)), draw.choice([True, False, None])))
    attempts += [(i, leads[i][1] + datetime.timedelta(hours=h), True) for i, h in ((1, 0), (2, 5), (3, 6))] + [(None, at, True)]
    end = at + datetime.timedelta(days=30)
    sent = spark.createDataFrame(leads, "lead long, at timestamp")
    tried = spark.createDataFrame(attempts, "lead long, at timestamp, ok boolean")
    expected = {r.lead: r.delivered for r in visitors.delivered_within(sent, tried, "lead", "at", "ok", 5).collect()}
    assert len(expected) == 200 and 20 < sum(expected.values()) < 180 and expected[2] is True
    ends = spark.createDataFrame([(900, end)], sent.schema), spark.createDataFrame([(900, end, True)], tried.schema)
    half = ["unix_timestamp(at) % 7200 < 3600 and at < '2026-01-02'", "unix_timestamp(at) % 7200 >= 3600 and at < '2026-01-02'", "at between '2026-01-02' and '2026-01-20'"]
    sources = [
        stream(spark, tmp_path / name, table.union(last), table.schema, [*half, "at > '2026-01-20'"])
        for name, table, last in (("leads", sent, ends[0]), ("tried", tried, ends[1]))
    ]
    found, query = drained(spark, jobs.delivered_stream(*sources, "lead", "at", "ok", 5, "2 days"), "deliveries")
    assert sorted((r.lead, r.delivered) for r in found.where("lead <> 900").collect()) == sorted(expected.items())
    # what the state still holds is what came after the watermark
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 6


@pytest.mark.parametrize("late", ["1 hour"])
def test_failure_counts(spark, tmp_path, late):
    at = datetime.datetime(2026, 1, 1)
    rows = [(at + datetime.timedelta(minutes=10 * i), "timeout" if i % 2 else "parse", 1.4) for i in range(30)]
    table = spark.createDataFrame(rows, "ts timestamp, kind string, seconds double")
    source = stream(spark, tmp_path / "in", table, table.schema, ["true"])
    counts = jobs.failure_counts(source, "ts", F.col("kind"), F.col("seconds"), late)
    query = counts.writeStream.format("memory").queryName("failures").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.failures for r in spark.table("failures").collect()} == {3}
