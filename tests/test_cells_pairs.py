import pytest

from eventsieve.operators import cells, similarity
from tests.test_cells import _classes
from tests.test_similarity import Weights, cards, near, score
from tests.test_spanning import families


@pytest.mark.parametrize("window", [7, None])
def test_pairs_of_blocks_of_any_size(spark, window, monkeypatch):
    """Small blocks, sums, chunks and batches of pairs; no rows for keys are made."""
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity, "keys", lambda *_: pytest.fail("rows for keys"))
    for name, value in (("MOST", 9), ("SUMS", 40), ("ADDED", 60), ("PAIRS", 3)):
        monkeypatch.setattr(cells, name, value)
    rows, context = cards(31, 60) + [(i + 500, *r[1:]) for i, r in enumerate(families(5, 40))], cards(77, 20, 1000)
    grouped = _classes(spark, rows)
    other = spark.createDataFrame(context, "id long, title array<string>, body array<string>, nums array<string>, day date")
    found = similarity.similar_classes(grouped, window, similarity.THRESHOLD, other).collect()
    classes, weigh = {r.class_id: (r.class_id, r.title, r.body, r.nums, r.day) for r in grouped.collect()}, Weights(rows + context)
    expected = {
        (a, b): round(score(classes[a], classes[b], weigh), 9) for a in classes for b in classes
        if a < b and (window is None or near(classes[a], classes[b], window)) and score(classes[a], classes[b], weigh) >= similarity.THRESHOLD
    }
    assert len(found) == len(expected) > 10
    assert {(r.a_id, r.b_id): round(r.score, 9) for r in found} == expected


def test_pairs_are_not_shuffled(spark):
    """The only shuffles after the articles are written are those of their bundles."""
    plan = similarity.similar_classes(_classes(spark, cards(31, 60)), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "codes" not in plan.split("RepartitionByExpression")[0]
