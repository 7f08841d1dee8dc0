"""The same rules over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from eventsieve.operators.publish import assemble_issue
from eventsieve.operators.visitors import CLOSED_IDLE_HOURS, IDLE_HOURS, failures_by_hour
from eventsieve.sources.files import append_history, read_history


def publish_stream(
    items: DataFrame, history_path: str, rank: list[Column], issue: str = "issue", look_back_days: int | None = 21
):
    """A stream writer that publishes the issues of each micro-batch against the history table.

    The history table is the state. An issue's partition is replaced as a whole, and an issue sees
    only issues before it, so a batch that runs again leaves the same table.
    """

    def publish(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        schema = None
        for (number,) in sorted(batch.select(issue).where(F.col(issue).isNotNull()).distinct().collect()):
            now = batch.where(F.col(issue) == number)
            schema = schema or now.withColumn("component", F.col("id")).schema
            before = read_history(spark, history_path, schema).where(F.col(issue) < number)
            out = assemble_issue(now, None if before.isEmpty() else before, rank, look_back_days)
            append_history(out.select(*schema.names), history_path, issue)
        batch.unpersist()

    return items.writeStream.foreachBatch(publish)


def retries_dropped(messages: DataFrame, keys: list[str], ts: str, within: str = "1 hour") -> DataFrame:
    """Each message once, as long as its copies come within the time."""
    return messages.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def failure_counts(rows: DataFrame, ts: str, kind: Column, seconds: Column, late: str = "1 hour") -> DataFrame:
    return failures_by_hour(rows.withWatermark(ts, late), ts, kind, seconds)


def delivered_stream(
    leads: DataFrame, attempts: DataFrame, lead: str, at: str, ok: str, hours: int, late: str = "1 hour"
) -> DataFrame:
    """(lead, sent_at, delivered) of each lead once, by the rule of visitors.delivered_within().

    A good attempt tells a lead delivered when it comes; a lead without one is told undelivered once the watermark is past its time.
    State is the leads and good attempts of the last `hours` and of what may still come late. Lead ids are not used twice.
    """
    sent = leads.select(lead, F.col(at).cast("timestamp").alias("sent_at")).withWatermark("sent_at", late)
    done = attempts.where(F.coalesce(F.col(ok), F.lit(False)))
    good = done.select(F.col(lead).alias("own"), F.col(at).cast("timestamp").alias("done_at")).withWatermark("done_at", late)
    last = F.expr(f"sent_at + interval {int(hours)} hours")
    on = (F.col(lead) == F.col("own")) & (F.col("done_at") >= F.col("sent_at")) & (F.col("done_at") <= last)
    told = sent.join(good, on, "leftOuter").select(lead, "sent_at", F.col("own").isNotNull().alias("delivered"))
    # a lead may have several good attempts
    return told.dropDuplicatesWithinWatermark([lead])


class _Sessions(StatefulProcessor):
    """Numbers a visitor's events in order of time, each once the watermark has passed it."""

    def __init__(self, kinds: dict[str, str], idle_hours: int, closed_idle_hours: int, keep_hours: int):
        self.kinds = kinds
        self.idle, self.closed_idle = idle_hours * _HOUR, closed_idle_hours * _HOUR
        self.keep = keep_hours * _HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", f"at long, closed boolean, tie {self.kinds['tie']}")
        self.seen = handle.getValueState("seen", "last long, closed boolean, session long")
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList(list(zip(at, frame["closed"].fillna(False).astype(bool).tolist(), frame["tie"].tolist())))
            first = min(at if first is None else [first, *at])
        # a timer is due when the watermark reaches it, which is when nothing before can come any more
        self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due = sorted((r for r in rows if r[0] <= passed * 1000), key=lambda r: (r[0], r[2] is not None, r[2]))
        last, was_closed, session = self.seen.get() if self.seen.exists() else (None, False, 0)
        if not due:
            # what still waits lies behind the watermark, so it is as far from the last event
            if last is not None and last + self.keep < passed * 1000:
                self.seen.clear()
            return
        rest = [r for r in rows if r[0] > passed * 1000]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        numbers = []
        for at, shut, _ in due:
            gap = None if last is None else at - last
            if gap is not None and gap > self.keep:
                session = 0
            if gap is None or gap > self.idle or (was_closed and gap > self.closed_idle):
                session += 1
            last, was_closed = at, shut
            numbers.append(session)
        self.seen.update((last, was_closed, session))
        self.handle.registerTimer(max((last + self.keep) // 1000, passed) + 1)
        stamps = pd.to_datetime([r[0] for r in due], unit="us")
        yield pd.DataFrame({"visitor": [key[0]] * len(due), "ts": stamps, "tie": [r[2] for r in due], "session": numbers})

    def close(self) -> None:
        pass


_HOUR = 3_600_000_000


def sessions_stream(
    events: DataFrame, visitor: str, ts: str, closed: str, tie: str, late: str = "1 hour",
    idle_hours: int = IDLE_HOURS, closed_idle_hours: int = CLOSED_IDLE_HOURS, keep_hours: int = 12 * IDLE_HOURS,
) -> DataFrame:
    """(visitor, ts, tie, session): sessions numbered per visitor in order of time, by the rule of visitors.sessions().

    Events wait in the state until the watermark has passed them and are then numbered in order of time and tie, so those that
    come up to `late` out of order get the numbers that the batch gives; later ones are dropped, as are events without a time. A
    visitor without an event for keep_hours is forgotten and begins at 1 again, which bounds the state. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    if keep_hours < idle_hours:
        raise ValueError("a visitor is kept for a session at least")
    kinds = {"visitor": events.schema[visitor].dataType.simpleString(), "tie": events.schema[tie].dataType.simpleString()}
    source = events.where(F.col(ts).isNotNull()).select(
        F.col(visitor).alias("visitor"), F.col(ts).cast("timestamp").alias("ts"), F.col(closed).alias("closed"), F.col(tie).alias("tie")
    )
    return (
        source.withWatermark("ts", late)
        .groupBy("visitor")
        .transformWithStateInPandas(
            _Sessions(kinds, idle_hours, closed_idle_hours, keep_hours),
            f"visitor {kinds['visitor']}, ts timestamp, tie {kinds['tie']}, session long",
            "append",
            "EventTime",
        )
    )
