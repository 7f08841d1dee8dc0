"""Membership sketches, and repeats that they hold back or let through."""

import random

import pytest
from pyspark.sql import functions as F

from eventsieve.operators import membership, publish

KINDS = "id long, text string, link string"


def brute(rows, old):
    """(id, first_id) by reading the rows in order, the history first."""
    first = {}
    for late, (i, text, link) in sorted([(False, r) for r in old] + [(True, r) for r in rows], key=lambda x: (x[0], x[1][0])):
        for mark in (("text", text), ("link", link)):
            if mark[1] is not None:
                first.setdefault(mark, (late, i))
    found = {}
    for i, text, link in rows:
        ends = [first[m] for m in (("text", text), ("link", link)) if m[1] is not None and first[m] != (True, i)]
        if ends:
            found[i] = min(ends)[1]
    return found


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    pick = lambda most: None if r.random() < 0.05 else f"t{r.randint(0, most)}"
    old = [(i, pick(3000), pick(3000)) for i in range(1, 400)]
    # a third of the rows has one text, which the history doesn't hold
    return [(i, "hot" if i % 3 == 0 else pick(3000), pick(6000)) for i in range(1000, 1900)] + [(2000, "", ""), (2001, "", None)], old


def test_bits_are_set_and_kept(spark):
    some = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"), "id")
    bits = membership.bits_for(1000)
    assert bits == 1 << 15 and membership.bits_for(0) == 1 << 15 and membership.bits_for(2049) == 1 << 16
    seen = membership.sketch(some, 1 << 17)
    every = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    found = {r.id for r in membership.likely(every, seen, 1 << 17).collect()}
    places = {(r.h % (1 << 17)) for r in some.collect()}
    assert found == {r.id for r in every.collect() if r.h % (1 << 17) in places}
    assert set(range(0, 3000, 3)) <= found and len(found) < 1100


def test_sketches_add_up(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("h"), "id")
    told = lambda s: sorted((r.chunk, r.size, bytes(r.bitmap)) for r in s.collect())
    parts = [membership.sketch(rows.where(f"id % 2 = {k}"), 1 << 16) for k in (0, 1)]
    assert told(membership.merged(*parts)) == told(membership.sketch(rows, 1 << 16))
    assert told(membership.sketch(rows.where("false"), 1 << 16)) == []


def test_a_sketch_is_never_larger_than_what_may_be_broadcast():
    assert membership.bits_for(10**13) == membership.MOST_BITS == 8 * (64 << 20)


@pytest.mark.parametrize("bits", [None, 8])
def test_repeats_match_brute_force(spark, tables, monkeypatch, bits):
    """A sketch that is far too small lets all through; the rows are the same."""
    if bits:
        monkeypatch.setattr(membership, "MOST_BITS", bits)
    rows, old = (spark.createDataFrame(t, KINDS) for t in tables)
    told = lambda *more, **kept: {r.id: r.first_id for r in publish.exact_repeats(rows, "id", "text", "link", *more, **kept).collect()}
    assert told() == brute(tables[0], [])
    assert told(old) == brute(*tables)
    parts = [publish.history_sketch(old.where(f"id % 2 = {k}"), "id", "text", "link", 5000) for k in (0, 1)]
    assert told(old, seen=membership.merged(*parts)) == brute(*tables)
    assert told(old.where("false")) == told(old.where("false"), seen=parts[0].where("false")) == brute(tables[0], [])


def test_what_is_shuffled_follows_the_hits(spark, monkeypatch):
    """1,000 new texts, ten of which a history of 20,000 holds: some ten rows of either reach the join."""
    sizes = {}
    plain = publish.materialize

    def counting(df, label):
        out = plain(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(publish, "materialize", counting)
    text = lambda first: F.concat(F.lit("text "), (F.col("id") + first).cast("string")).alias("text")
    old, new = spark.range(20000).select("id", text(0)), spark.range(30000, 31000).select("id", text(-10010))
    found = publish.exact_repeats(new, "id", "text", None, old)
    assert {r.id: r.first_id for r in found.collect()} == {30000 + i: 19990 + i for i in range(10)}
    assert sizes["likely"] < 150 and sizes["firsts"] < 150


def test_empty_tables(spark):
    none = spark.createDataFrame([], KINDS)
    assert publish.exact_repeats(none, "id", "text", "link", none).count() == 0
