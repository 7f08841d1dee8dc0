import datetime
import random

import pytest

from eventsieve.operators import cells, similarity, spanning
from eventsieve.plans.tables import materialize
from tests.test_similarity import PRINT, VOCABULARY, Weights, cards, components, near, score
from tests.test_spanning import families


def _classes(spark, rows):
    return materialize(similarity.classes(spark.createDataFrame(rows, PRINT)), "classes")


@pytest.mark.parametrize("window", [7, None])
def test_blocks_of_any_size_link_what_all_pairs_link(spark, window, monkeypatch):
    """Small blocks, sums and chunks; rows without a day and with numbers among them; no rows for keys are made."""
    monkeypatch.setattr(spanning, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity, "keys", lambda *_: pytest.fail("rows for keys"))
    for name, value in (("MOST", 9), ("SUMS", 40), ("ADDED", 60)):
        monkeypatch.setattr(cells, name, value)
    rows = cards(31, 60) + [(i + 500, *r[1:]) for i, r in enumerate(families(5, 40))]
    grouped = _classes(spark, rows)
    found = {r.node: r.component for r in spanning.linked_classes(grouped, window).collect()}
    classes, weigh = {r.class_id: (r.class_id, r.title, r.body, r.nums, r.day) for r in grouped.collect()}, Weights(rows)
    edges = [
        (a, b) for a in classes for b in classes
        if a < b and (window is None or near(classes[a], classes[b], window)) and score(classes[a], classes[b], weigh) >= similarity.THRESHOLD
    ]
    assert len(edges) > 10
    assert {i: found.get(i, i) for i in classes} == components(list(classes), edges)


def test_a_family_gives_no_more_links_than_members_a_cell(spark):
    """400 near copies have 79,800 links."""
    day = datetime.date(2026, 9, 1)
    rows = [(i, VOCABULARY[:4], sorted([*VOCABULARY[:12], f"own{i}"]), [], day + datetime.timedelta(i % 8)) for i in range(400)]
    random.Random(3).shuffle(rows)
    grouped = _classes(spark, rows)
    n, counts = similarity.corpus(grouped)
    packed = cells.packed(grouped, counts, {"w": lambda df: similarity.weight(similarity.F.lit(n), df)}, 2)
    assert cells.links(packed, n, 7, similarity.THRESHOLD, 1 << 23).count() == 399
    # 16 blocks, each in 17 cells at most
    assert cells.links(packed, n, 7, similarity.THRESHOLD).count() < 17 * 400
