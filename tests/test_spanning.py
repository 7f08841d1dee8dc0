import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventsieve.operators import components as components_module
from eventsieve.operators import similarity, spanning
from eventsieve.operators.components import connected_components
from eventsieve.plans.tables import materialize
from tests.test_similarity import PRINT, VOCABULARY, cards, components, near, score, Weights


def families(seed, n=40, size=6):
    """Families of near copies on neighbouring days, some chained by a few words only, next to articles of their own."""
    draw, rows = random.Random(seed), []
    for f in range(n // size):
        title, body = draw.sample(VOCABULARY, 4), draw.sample(VOCABULARY, 9)
        for i in range(size):
            own = set(title[: 4 - i % 3]) | {draw.choice(VOCABULARY)}
            day = None if draw.random() < 0.1 else datetime.date(2026, 9, 1) + datetime.timedelta(4 * f + 3 * i)
            rows.append((len(rows), sorted(own), sorted(own | set(body[i % 4 :])), [], day))
    return rows


@pytest.mark.parametrize(("window", "few"), [(7, 0), (None, 0), (7, 1 << 23)])
def test_components_are_those_of_all_links(spark, window, few, monkeypatch):
    monkeypatch.setattr(spanning, "FEW_PAIRS", few)
    for rows in (cards(11, 70), families(4)):
        prints = spark.createDataFrame(rows, PRINT)
        grouped = materialize(similarity.classes(prints), "classes")
        found = {r.node: r.component for r in spanning.linked_classes(grouped, window).collect()}
        classes = {r.class_id: (r.class_id, r.title, r.body, r.nums, r.day) for r in grouped.collect()}
        weigh = Weights(rows)
        edges = [
            (a, b) for a in classes for b in classes
            if a < b and (window is None or near(classes[a], classes[b], window)) and score(classes[a], classes[b], weigh) >= similarity.THRESHOLD
        ]
        least = components(list(classes), edges)
        assert {i: found.get(i, i) for i in classes} == least
        assert len(edges) > 10


def test_a_family_costs_as_many_comparisons_as_it_has_members(spark):
    """One passage with a word of its own each: 400 near copies on 8 days have 79,800 links."""
    passage = VOCABULARY[:12]
    day = datetime.date(2026, 9, 1)
    rows = [(i, passage[:4], sorted([*passage, f"own{i}"]), [], day + datetime.timedelta(i % 8)) for i in range(400)]
    rows += [(1000 + i, [f"t{i}"], sorted([f"t{i}", *VOCABULARY[12 + i % 9 : 16 + i % 9]]), [], day) for i in range(60)]
    grouped = materialize(similarity.classes(spark.createDataFrame(rows, PRINT)), "classes")
    n, sets = similarity.weighted_classes(grouped)
    held = similarity.keys(sets, similarity.THRESHOLD, n)
    tried = materialize(spanning.stars(held, 7), "stars")
    links = similarity.scored(tried, sets, n, similarity.THRESHOLD)
    first = materialize(connected_components(links, "a_id", "b_id"), "first")
    left = spanning.across(held, first, 7).where("a_id < 1000 and b_id < 1000")
    assert tried.where("b_id < 1000").count() < 4 * 400 and left.count() == 0
    assert first.where("node < 1000").agg(F.count_distinct("component")).first()[0] == 1


def test_bounds_never_drop_a_pair(spark):
    """Every pair that scores enough shares a key whose bounds it reaches, whatever the bitmaps hold."""
    rows = cards(21, 90) + [(i + 500, *r[1:]) for i, r in enumerate(families(9, 60))]
    grouped = materialize(similarity.classes(spark.createDataFrame(rows, PRINT)), "classes")
    found = {(r.a_id, r.b_id) for r in similarity.similar_classes(grouped, None).collect()}
    classes, weigh = {r.class_id: (r.class_id, r.title, r.body, r.nums, r.day) for r in grouped.collect()}, Weights(rows)
    assert found == {(a, b) for a in classes for b in classes if a < b and score(classes[a], classes[b], weigh) >= similarity.THRESHOLD}


@pytest.mark.parametrize(("run", "split"), [(7, 10), (1 << 18, 1 << 20)])
def test_contraction_keeps_components(spark, monkeypatch, run, split):
    monkeypatch.setattr(components_module, "RUN", run)
    monkeypatch.setattr(components_module, "SPLIT", split)
    draw = random.Random(run)
    chain = [(i, i + 1) for i in range(300)]
    draw.shuffle(chain)
    graphs = {
        "chain": chain,
        "random": [(draw.randrange(500), draw.randrange(500)) for _ in range(260)],
        "hub": [(0, i) for i in range(1, 200)] + [(1000, 1001), (1001, 1001), (None, 3), (1001, 1000)],
    }
    for edges in graphs.values():
        table = spark.createDataFrame(edges, "a long, b long").repartition(5)
        real = [(a, b) for a, b in edges if a is not None and a != b]
        least = components({x for e in real for x in e}, real)
        assert {r.node: r.component for r in connected_components(table, "a", "b").collect()} == least
        if run < split // 2:
            continue
        named = table.select(F.format_string("n%04d", "a").alias("a"), F.format_string("n%04d", "b").alias("b"))
        names = named.where("a <> 'nnull' and b <> 'nnull'")
        assert {r.node: r.component for r in connected_components(names, "a", "b").collect()} == {f"n{k:04}": f"n{v:04}" for k, v in least.items()}


def test_stars_of_a_long_chain_are_found_without_recursion():
    us, vs = components_module._stars(list(range(1, 50001)), list(range(50000)))
    assert set(vs) == {0} and sorted(us) == list(range(1, 50001))
