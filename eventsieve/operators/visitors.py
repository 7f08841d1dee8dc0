"""Rules over visitor data: campaigns, leads, chats, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsieve.functions.urls import language, links, without_fragment
from eventsieve.plans.tables import materialize

# Shapes of addresses and session ids, lengths of sessions and logs.
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
SESSION_ID = r"^[a-f0-9]{24}$"
IDLE_HOURS, CLOSED_IDLE_HOURS = 30 * 24, 12
MOST_LOG, HISTORY_TURNS = 60, 12


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


class Segments:
    """Rows dealt by ranges of (visitor, order), so that one visitor's rows may lie in many tasks.

    What a row needs of those before it is read within its segment, the visitor's rows of one range, and carried from segment
    to segment through a table of one row each. Rows of equal order lie in one range.
    """

    def __init__(self, rows: DataFrame, visitor: str, order: list[str]):
        self.order, self.part, self.who = order, _free("part", rows.columns), _free("who", rows.columns)
        dealt = rows.repartitionByRange(visitor, *order).withColumn(self.part, F.spark_partition_id())
        # the ranges are drawn from a sample: written, so that all passes see the same ones
        self.rows = materialize(dealt.withColumn(self.who, F.col(visitor)), "segments")
        self.own = [self.who, self.part]
        self.within = Window.partitionBy(*self.own).orderBy(*order)
        self.upto = self.within.rowsBetween(Window.unboundedPreceding, 0)
        self.earlier = Window.partitionBy(self.who).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, rows: DataFrame, sums: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """rows with the columns carried: sums of each segment, looked at over the visitor's earlier segments."""
        cells = rows.groupBy(*self.own).agg(*[c.alias(n) for n, c in sums.items()])
        who, part, held = (_free(n, rows.columns) for n in ("c_who", "c_part", "c_held"))
        values = F.struct(*[c.over(self.earlier).alias(n) for n, c in carried.items()])
        # written, so that the join stands alone and can split what is too large for a task
        seen = materialize(cells.select(F.col(self.who).alias(who), F.col(self.part).alias(part), values.alias(held)), "carried")
        same = rows[self.who].eqNullSafe(seen[who]) & (rows[self.part] == seen[part])
        return rows.join(seen, same).select(*rows.columns, *[F.col(f"{held}.{n}").alias(n) for n in carried])


def attributed(landings: DataFrame, session: str, order: list[str], campaign: str, referrer: str) -> DataFrame:
    """Adds last_touch and first_referrer.

    A landing with any campaign key replaces the whole campaign map from then
    on; the first referrer that is not empty stays. A visitor may have any share of all landings; see Segments.
    """
    columns = [c for c in landings.columns if c not in ("last_touch", "first_referrer")]
    cut = Segments(landings.select(*columns), session, order)
    set_now = F.when(F.size(campaign) > 0, F.col(campaign))
    named = F.nullif(F.col(referrer), F.lit(""))
    at = F.struct(*order)
    touch, first, c_touch, c_first = (_free(n, columns) for n in ("touch_", "first_", "c_touch", "c_first"))
    sums = {
        touch: F.max_by(F.struct(set_now.alias("v")), F.when(set_now.isNotNull(), at))["v"],
        first: F.min_by(named, F.when(named.isNotNull(), at)),
    }
    rows = cut.carry(cut.rows, sums, {c_touch: F.last(touch, ignorenulls=True), c_first: F.first(first, ignorenulls=True)})
    return rows.select(
        *columns,
        F.coalesce(F.last(set_now, ignorenulls=True).over(cut.upto), c_touch).alias("last_touch"),
        F.coalesce(c_first, F.first(named, ignorenulls=True).over(cut.upto)).alias("first_referrer"),
    )


def lead_errors(required: dict[str, Column], emails: dict[str, Column], checked: dict[str, Column]) -> Column:
    """array<struct<field, code>>: blank required fields, bad addresses, missing consents."""
    blank = lambda c: F.btrim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    found = []
    for name, value in required.items():
        found.append(F.when(blank(value), F.struct(F.lit(name).alias("field"), F.lit("required").alias("code"))))
    for name, value in emails.items():
        bad = ~blank(value) & ~F.btrim(value).rlike(EMAIL_SHAPE)
        found.append(F.when(bad, F.struct(F.lit(name).alias("field"), F.lit("email").alias("code"))))
    for name, value in checked.items():
        missing = ~F.coalesce(value, F.lit(False))
        found.append(F.when(missing, F.struct(F.lit(name).alias("field"), F.lit("consent").alias("code"))))
    return F.array_compact(F.array(*found))


def checked_leads(leads: DataFrame, errors: Column, honeypot: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): any error rejects; a filled trap field drops a lead silently and is never kept.

    The quarantine has a further column errors; where the leads have one, its name gets underscores until it is free.
    """
    name = _free("errors", leads.columns)
    judged = leads.withColumn(name, errors)
    wrong = F.size(name) > 0
    trapped = F.coalesce(F.col(honeypot), F.lit("")) != ""
    return judged.where(~wrong & ~trapped).drop(name, honeypot), judged.where(wrong).drop(honeypot)


def lead_records(
    leads: DataFrame, fields: str, labels: dict[str, str], form_type: str, page: str, lang: str, referrer: str, campaign: str,
    prefix: Column | None = None, texts: str | None = None,
) -> DataFrame:
    """Adds raw and display maps and the subject.

    raw has every field trimmed; display has labels as keys, without empty
    values and without consent. texts is a map column of what is shown for a field instead of its value, as the choices of a
    list are. Metadata overwrite fields of the same name.
    """
    raw = F.transform_values(fields, lambda k, v: F.btrim(F.coalesce(v, F.lit(""))))
    label_of = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else None
    named = (lambda k: F.coalesce(F.try_element_at(label_of, k), k)) if labels else (lambda k: k)
    base = F.map_from_arrays(
        F.array(F.lit("page_url"), F.lit("language"), F.lit("referrer")),
        F.array(without_fragment(F.col(page)), language(F.col(lang)), F.coalesce(referrer, F.lit(""))),
    )
    extra = _over(base, F.coalesce(F.col(campaign), F.create_map().cast("map<string,string>")))
    told = raw if texts is None else F.transform_values(raw, lambda k, v: F.btrim(F.coalesce(F.try_element_at(texts, k), v)))
    kept = F.map_filter(told, lambda k, v: (v != "") & (k != "consent"))
    shown = F.transform_keys(kept, lambda k, v: named(k))
    typed = F.create_map(F.lit("form_type"), F.col(form_type))
    one = lambda k: F.nullif(F.try_element_at(raw, F.lit(k)), F.lit(""))
    start = prefix if prefix is not None else F.when(language(F.col(lang)) == "ru", "Заявка с сайта: ").otherwise("Website inquiry: ")
    return leads.withColumns(
        {
            "raw": _over(_over(typed, raw), extra),
            "display": _over(shown, F.map_filter(extra, lambda k, v: v != "")),
            "subject": F.concat(start, F.coalesce(one("product"), one("company"), F.col(form_type))),
        }
    )


def _over(below: Column, above: Column) -> Column:
    """Both maps' entries; of equal keys those of above."""
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def delivered(attempts: DataFrame, lead: str, ok: str) -> DataFrame:
    """(lead, delivered): a lead is delivered if any attempt was."""
    return attempts.groupBy(lead).agg(F.bool_or(F.coalesce(F.col(ok), F.lit(False))).alias("delivered"))


def delivered_within(leads: DataFrame, attempts: DataFrame, lead: str, at: str, ok: str, hours: int) -> DataFrame:
    """(lead, delivered) of each lead: whether an attempt from its own time to `hours` later, both included, was good.

    A lead without attempts was not delivered, nor was one without a time. Rows that repeat a lead are one lead, delivered if any of them was.
    """
    own, done = F.col(lead).alias("own"), attempts.where(F.coalesce(F.col(ok), F.lit(False)))
    good = done.select(own, F.col(at).alias("done_at"))
    due = leads.select(F.col(lead), F.col(at).alias("sent_at"))
    last = F.col("sent_at") + F.make_dt_interval(hours=F.lit(hours))
    joined = due.join(good, (F.col(lead) == F.col("own")) & F.col("done_at").between(F.col("sent_at"), last), "left")
    return joined.groupBy(lead).agg(F.bool_or(F.col("own").isNotNull()).alias("delivered"))


def sessions(
    events: DataFrame, visitor: str, ts: str, closed: Column, tie: str,
    idle_hours: int = IDLE_HOURS, closed_idle_hours: int = CLOSED_IDLE_HOURS,
) -> DataFrame:
    """Adds session, numbered from 1 for each visitor.

    A session ends after idle_hours without activity, or closed_idle_hours once it was closed; both strictly. A visitor may have
    any share of all events; see Segments.
    """
    columns = [c for c in events.columns if c != "session"]
    at, shut, new, before, prior, last, nth = (_free(n, columns) for n in ("at", "shut", "new", "before", "prior", "last", "nth"))
    marked = events.select(*columns, F.unix_micros(F.col(ts).cast("timestamp")).alias(at), F.coalesce(closed, F.lit(False)).alias(shut))
    cut = Segments(marked, visitor, [ts, tie])
    own = F.struct(at, shut)
    rows = cut.carry(cut.rows, {last: F.max_by(own, F.struct(ts, tie))}, {prior: F.last(last)})
    rows = rows.withColumn(before, F.coalesce(F.lag(own).over(cut.within), F.col(prior)))
    gap = F.col(at) - F.col(f"{before}.{at}")
    hours = lambda h: F.lit(h * 3_600_000_000)
    starts = F.col(before).isNull() | gap.isNull() | (gap > hours(idle_hours)) | (F.col(f"{before}.{shut}") & (gap > hours(closed_idle_hours)))
    rows = materialize(rows.withColumn(new, starts.cast("int")).drop(before, prior), "starts")
    rows = cut.carry(rows, {nth: F.sum(new)}, {nth: F.sum(nth)})
    return rows.select(*columns, (F.coalesce(nth, F.lit(0)) + F.sum(new).over(cut.upto)).cast("long").alias("session"))


def capped_log(messages: DataFrame, chat: str, order: str, most: int = MOST_LOG) -> DataFrame:
    """The latest `most` messages of each chat."""
    latest = Window.partitionBy(chat).orderBy(F.col(order).desc())
    n = _free("n", messages.columns)
    return messages.withColumn(n, F.row_number().over(latest)).where(F.col(n) <= most).drop(n)


def with_history(messages: DataFrame, chat: str, order: str, who: Column, text: str, turns: int = HISTORY_TURNS) -> DataFrame:
    """Adds history: the `turns` messages before each one, oldest first, as array<struct<role, text>>."""
    before = Window.partitionBy(chat).orderBy(order).rowsBetween(-turns, -1)
    role = F.when(who == "me", "user").otherwise("assistant")
    return messages.withColumn("history", F.collect_list(F.struct(role.alias("role"), F.col(text).alias("text"))).over(before))


def split_session_ids(rows: DataFrame, sid: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) by the shape of the session id."""
    good = F.coalesce(F.col(sid).rlike(SESSION_ID), F.lit(False))
    return rows.where(good), rows.where(~good)


def without_retries(messages: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each message id, however often it was sent."""
    return messages.dropDuplicates(keys)


def failure_class(name: Column, message: Column) -> Column:
    return F.when(name == "AbortError", "timeout").otherwise(F.coalesce(message, F.lit("")))


def failures_by_hour(rows: DataFrame, ts: str, kind: Column, seconds: Column) -> DataFrame:
    """(hour, kind, failures, seconds): counts and mean whole seconds by class and hour."""
    return (
        rows.groupBy(F.window(ts, "1 hour").alias("w"), kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("failures"), F.avg(F.round(seconds)).alias("seconds"))
        .select(F.col("w.start").alias("hour"), "kind", "failures", "seconds")
    )


def extracted_links(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, value) of every link and address in a text."""
    return rows.select(key, F.posexplode(links(F.col(text))).alias("pos", "found")).select(
        key, "pos", F.col("found.kind").alias("kind"), F.col("found.value").alias("value")
    )
