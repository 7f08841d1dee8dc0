"""Word counts that a history keeps, and what an issue does with them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventsieve.operators import publish, similarity

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def items(spark):
    r = random.Random(5)
    rows = []
    for i in range(90):
        body = sorted(r.sample(WORDS, r.randint(0, 9)))
        day = None if i % 11 == 0 else datetime.date(2026, 9, 1) + datetime.timedelta(days=i // 6)
        rows.append((i, body[: len(body) // 2], body, ["9"] if i % 7 == 0 else [], day, i, i // 18))
    # a text that comes back in each issue
    rows += [(100 + k, ["w1", "w2"], ["w1", "w2", "w3"], [], datetime.date(2026, 9, 2 + 3 * k), 100 + k, k) for k in range(5)]
    kinds = "id long, title array<string>, body array<string>, nums array<string>, day date, pos long, issue int"
    return spark.createDataFrame(rows, kinds)


def told(counts):
    n, rows = counts
    return n, {r.token: r.df for r in rows.collect()}


def test_kept_counts_are_those_of_a_recount(items):
    now, before = similarity.classes(items.where("issue = 3")), items.where("issue < 3")
    kept = similarity.day_counts(items.where("issue < 2")).unionByName(similarity.day_counts(items.where("issue = 2")))
    assert told(similarity.corpus(now, before)) == told(similarity.corpus(now, None, kept))
    since = F.col("day").isNull() | (F.col("day") >= "2026-09-05")
    assert told(similarity.corpus(now, before.where(since))) == told(similarity.corpus(now, None, kept.where(since)))


def test_no_article_and_no_word(items):
    n, counts = similarity.corpus(similarity.classes(items.where("false")))
    assert n == 0 and counts.count() == 0
    n, counts = similarity.corpus(similarity.classes(items.where("size(body) = 0")), items.where("false"))
    assert n == items.where("size(body) = 0").count() and counts.count() == 0


def test_numbers_of_words_are_written_once(items):
    """Both sides of a match read the same numbers: the plan holds nothing that could number the words anew."""
    _, counts = similarity.corpus(similarity.classes(items))
    assert "monotonically" not in counts._jdf.queryExecution().toString()
    numbers = [r.number for r in counts.collect()]
    assert len(set(numbers)) == len(numbers)


@pytest.mark.parametrize("look_back", [None, 4])
def test_issues_are_those_of_a_recount(items, monkeypatch, look_back):
    monkeypatch.setattr(publish, "COMPACT", 2)
    shown = lambda rows: sorted((r.issue, r.id, r.component) for r in rows.collect())
    kept = shown(publish.publish_issues(items, "issue", [F.col("pos")], look_back))
    plain = publish.assemble_issue
    monkeypatch.setattr(publish, "assemble_issue", lambda *args: plain(*args[:-1]))
    assert kept == shown(publish.publish_issues(items, "issue", [F.col("pos")], look_back))
    assert 0 < len(kept) < items.count()


def test_matches_by_kept_counts(items):
    now, before = items.where("issue >= 3"), items.where("issue < 3")
    grouped = similarity.classes(now)
    rows = lambda counted: sorted(similarity.best_published(grouped, before, counted=counted).collect())
    assert rows(similarity.day_counts(before)) == rows(None) != []
