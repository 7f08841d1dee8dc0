import datetime
import math
import random

from pyspark.sql import functions as F

from eventsieve.operators import components as components_module
from eventsieve.operators import publish, similarity
from eventsieve.operators.components import connected_components

VOCABULARY = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
PRINT = "id long, title array<string>, body array<string>, nums array<string>, day date"


def cards(seed, n, first=0):
    draw, rows = random.Random(seed), []
    for i in range(n):
        title = set(draw.choices(VOCABULARY, k=draw.randint(0, 5)))
        body = title | set(draw.choices(VOCABULARY, weights=[1 / (k + 1) for k in range(64)], k=draw.randint(0, 9)))
        day = None if draw.random() < 0.15 else datetime.date(2026, 9, 1) + datetime.timedelta(draw.randint(0, 25))
        rows.append((first + i, sorted(title), sorted(body), draw.choices("12345", k=draw.randint(0, 1)), day))
    for i in range(n // 6):
        rows.append((first + n + i, *rows[draw.randrange(n)][1:]))
    return rows


class Weights:
    def __init__(self, rows):
        self.n, self.df = len(rows), {}
        for r in rows:
            for t in r[2]:
                self.df[t] = self.df.get(t, 0) + 1

    def __call__(self, tokens):
        return sum(math.log((self.n + 1) / (self.df.get(t, 0) + 1)) + 1 for t in tokens)


def score(a, b, weigh):
    def dice(x, y):
        return 2 * weigh(set(x) & set(y)) / (weigh(x) + weigh(y)) if x and y else 0.0

    return (dice(a[1], b[1]) + dice(a[2], b[2])) / 2 + (0.1 if set(a[3]) & set(b[3]) else 0)


def near(a, b, window):
    return a[4] is None or b[4] is None or abs((a[4] - b[4]).days) <= window


def components(nodes, edges):
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_pairs_match_brute_force(spark):
    for seed in range(3):
        rows, context = cards(seed, 60), cards(seed + 50, 20, 1000)
        prints, other = (spark.createDataFrame(x, PRINT) for x in (rows, context))
        found = similarity.similar_classes(similarity.classes(prints), 7, 0.34, other).collect()
        weigh, first = Weights(rows + context), {}
        for r in rows:
            first.setdefault(str(r[1:]), r)
        expected = {
            (a[0], b[0]): round(score(a, b, weigh), 9)
            for a in first.values() for b in first.values()
            if a[0] < b[0] and near(a, b, 7) and score(a, b, weigh) >= 0.34
        }
        assert {(r.a_id, r.b_id): round(r.score, 9) for r in found} == expected


def test_pairs_that_meet_by_titles_may_owe_their_score_to_the_rest_of_the_body(spark):
    rows, day = [], datetime.date(2026, 9, 1)
    for m in range(20, 100, 4):
        both = [f"p{m}title{i}" for i in range(5)], [f"p{m}lead{i}" for i in range(2)]
        for side in "xy":
            title = both[0] + [f"p{m}{side}t{i}" for i in range(3)]
            rows.append((len(rows), sorted(title), sorted(title + both[1] + [f"p{m}{side}{i}" for i in range(m)]), [], day))
    weigh = Weights(rows)
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and score(a, b, weigh) >= 0.34}
    assert 5 < len(expected) < 20
    found = similarity.similar_classes(similarity.classes(spark.createDataFrame(rows, PRINT)), 7)
    assert {(r.a_id, r.b_id) for r in found.collect()} == expected


def test_clusters_match_brute_force(spark):
    rows = cards(9, 50)
    found = {r.id: r.component for r in publish.cluster(spark.createDataFrame(rows, PRINT)).collect()}
    weigh = Weights(rows)
    edges = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b, 7) and score(a, b, weigh) >= 0.34]
    assert found == components([r[0] for r in rows], edges)


def test_best_published_matches_brute_force(spark):
    for seed in range(3):
        rows, old = cards(seed, 30), cards(seed + 20, 40, 1000)
        prints = spark.createDataFrame(rows, PRINT)
        published = spark.createDataFrame(old, PRINT).withColumn("pos", F.col("id"))
        found = {r.id: (r.old_id, round(r.score, 9)) for r in publish.published_matches(prints, published).collect()}
        expected = {}
        for c in rows:
            weigh, best = Weights([*old, c]), None
            for o in old:
                s = round(score(c, o, weigh), 12)
                if near(c, o, 10) and s >= 0.34 and (best is None or s >= best[1]):
                    best = (o[0], s)
            if best:
                expected[c[0]] = (best[0], round(best[1], 9))
        assert found == expected


def test_components_of_random_graphs(spark, monkeypatch):
    draw = random.Random(1)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)]
    edges += [(5000, 6000 + i) for i in range(300)]
    table = spark.createDataFrame(edges + edges[:50] + [(None, 3), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(table, "a", "b").collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert found == components(sorted(nodes), [e for e in edges if e[0] != e[1]])
    assert connected_components(table.limit(0), "a", "b").count() == 0
    monkeypatch.setattr(components_module, "SPLIT", 10)
    assert {r.node: r.component for r in connected_components(table, "a", "b").collect()} == found


def item(n, title, extract="", day="2026-09-17", url="https://example.com/"):
    return n, n, title, extract, day, url


def prepared(spark, items):
    rows = spark.createDataFrame(items, "id long, pos long, title string, extract string, day string, url string")
    return rows, similarity.fingerprints(rows, "id", F.col("title"), F.col("extract"), F.col("day"))


def test_reprints_make_one_card_and_stages_stay_apart(spark):
    items = [
        item(0, "Exports soar to record high of $9.11B in August", "Outbound shipments hit $9.11B.", url="https://www.msn.com/a"),
        item(1, "PH exports hit 35-year high at $9.11B", "Outbound shipments reach $9.11B.", url="https://psa.gov.ph/x"),
        item(2, "Pork tariff proposal backed by hog raisers", "Raisers back a phased plan."),
        item(3, "Importers protest against tariffs on pork", "Importers call the move harmful to consumers."),
    ]
    rows, prints = prepared(spark, items)
    found = rows.withColumnRenamed("id", "own").join(publish.cluster(prints), F.col("own") == F.col("id")).drop("own")
    from eventsieve.functions.urls import source_rank

    primary = publish.primaries(found.withColumn("rank", source_rank(F.col("url"))), [F.col("rank")])
    assert {(r.id, r["size"]) for r in primary.collect()} == {(1, 2), (2, 1), (3, 1)}
    also = publish.also_reported(found.withColumn("rank", source_rank(F.col("url"))), [F.col("rank")], "url").collect()
    assert [(r.ord, r.url) for r in also] == [(2, "https://www.msn.com/a")]


def test_also_reported_keeps_all_of_a_crowded_component(spark):
    draw = random.Random(2)
    rows = [(i, 7 if i < 2500 else 10000 + i // 2, draw.randrange(5), draw.choice([None, 1, 2])) for i in range(3000)]
    draw.shuffle(rows)
    items = spark.createDataFrame(rows, "pos long, component long, rank long, other long").withColumn("id", F.col("pos") * 2)
    expected = {}
    for pos, component, *_ in sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or 0, r[0])):
        expected.setdefault(component, []).append(pos * 2)
    expected = {(c, n, i) for c, ids in expected.items() for n, i in enumerate(ids, 1) if n > 1}
    # whether the ranges are joined again or not
    for joined in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
        try:
            found = publish.also_reported(items, [F.col("rank"), F.col("other")], "id").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(found) == len(expected) and {(r.component, r.ord, r.id) for r in found} == expected


def test_same_statistic_a_month_apart_is_no_repeat(spark):
    a = item(0, "Inflation eases to 3.5% on cheaper food", "Prices grew slower.", "2026-08-05")
    b = item(1, "Inflation eases to 3.5% on cheaper food", "Prices grew slower.", "2026-09-05")
    _, prints = prepared(spark, [a, b])
    assert len({r.component for r in publish.cluster(prints).collect()}) == 2
    old = prints.where("id = 0").withColumn("pos", F.col("id"))
    assert publish.published_matches(prints.where("id = 1"), old).count() == 0
    assert publish.published_matches(prints.where("id = 1"), old, window_days=40).count() == 1


def test_pair_quality_and_repeats_by_link(spark):
    rows = [(0, 1, "a"), (1, 1, "a"), (2, 1, "b"), (3, 2, "b"), (4, 2, None), (5, 3, "a")]
    found = publish.pair_quality(spark.createDataFrame(rows, "id long, component long, label string"), F.col("label")).first()
    assert tuple(found) == (3, 4, 1, 1 / 3, 1 / 4)
    none = publish.pair_quality(spark.createDataFrame([], "id long, component long, label string"), F.col("label")).first()
    assert tuple(none) == (0, 0, 0, None, None)
    shape = "id long, text string, link string"
    old = spark.createDataFrame([(90, "old", "l9"), (91, None, None)], shape)
    items = spark.createDataFrame(
        [(1, "x", "l1"), (2, "x", "l2"), (3, "y", "l1"), (4, "old", None), (5, "z", "l9"), (6, None, None), (7, None, "l2"), (8, "old", "l1")], shape
    )
    repeats = lambda *more: {r.id: r.first_id for r in publish.exact_repeats(items, "id", "text", *more).collect()}
    assert repeats() == {2: 1, 8: 4}
    assert repeats("link") == {2: 1, 3: 1, 7: 2, 8: 1}
    assert repeats("link", old) == {2: 1, 3: 1, 4: 90, 5: 90, 7: 2, 8: 90}


def test_look_back_leaves_old_history_out(spark):
    a = item(0, "Exports soar to record high of $9.11B in August", "Outbound shipments hit $9.11B.", "2026-09-01")
    b = item(1, "PH exports hit 35-year high at $9.11B", "Outbound shipments reach $9.11B.", "2026-09-08")
    _, prints = prepared(spark, [a, b])
    items = prints.withColumn("pos", F.col("id")).withColumn("issue", F.col("id"))
    shown = lambda days: {r.id for r in publish.publish_issues(items, "issue", [F.col("pos")], days).collect()}
    assert shown(None) == shown(7) == {0} and shown(6) == {0, 1}


def test_prompt_lines(spark):
    rows = [(1, "Title", " ".join(f"w{i}" for i in range(50)), datetime.date(2026, 9, 1)), (2, None, None, None)]
    heads = spark.createDataFrame(rows, "n int, title string, extract string, day date")
    found = [r.line for r in publish.prompt_lines(heads, "n", "title", "extract", "day").orderBy("n").collect()]
    assert found == [f"1. [2026-09-01] Title :: {' '.join(f'w{i}' for i in range(40))}", "2. [no date]  :: "]


def test_verdicts(spark):
    answers = [
        "not json", '{"groups": "x"}', '{"groups": [["a", 99]]}', 'so: {"groups": [[2, 1, "2"], [3]]} end', None,
        '{"groups": 5}', '{"groups": [["²", 1]]}',
    ]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    found = rows.orderBy("i").select(publish.verdict_groups(F.col("a"), F.lit(3)).alias("g")).collect()
    cleaned = [[g for g in r.g if g] for r in found]
    assert cleaned == [[], [], [], [[0, 1], [2]], [], [], [[0]]]


def test_a_verdict_merges_only_what_shares_words(spark):
    rows = cards(4, 25)
    prints = spark.createDataFrame(rows, PRINT)
    found = publish.cluster(prints)
    heads = found.groupBy("component").agg(F.min("id").alias("n")).select("n", "component")
    ids = sorted(r.n for r in heads.collect())
    everything = spark.createDataFrame([(ids,)], "group array<long>")
    head_prints = prints.join(heads.select(F.col("n").alias("id")), "id").select(*[c.split()[0] for c in PRINT.split(", ")])
    merged = {r.component: r.merged for r in publish.merged_components(heads, head_prints, everything).collect()}
    by_id = {r[0]: r for r in rows}
    weigh = Weights([by_id[i] for i in ids])
    edges = [(a, b) for a in ids for b in ids if a < b and score(by_id[a], by_id[b], weigh) >= 0.12]
    assert merged == components(ids, edges)
    nothing = publish.merged_components(heads, head_prints, everything.limit(0))
    assert all(r.component == r.merged for r in nothing.collect())
