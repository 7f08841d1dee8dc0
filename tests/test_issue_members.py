from pyspark.sql import functions as F

from eventsieve.operators import publish, similarity
from tests.test_similarity import PRINT, cards


def test_an_issue_joins_its_fingerprints_to_their_classes_once(spark, monkeypatch):
    """Rows without words and copies among them; the history holds some of the issue."""
    made, members, written, write = [], similarity.members, [], publish.materialize
    monkeypatch.setattr(similarity, "members", lambda *sides: made.append(1) or members(*sides))
    monkeypatch.setattr(publish, "materialize", lambda df, label: written.append((label, "body" in df.columns)) or write(df, label))
    rows = cards(7, 40) + [(100 + k, [], [], [], None) for k in range(2)]
    items = spark.createDataFrame([(*r, k) for k, r in enumerate(rows + [(200 + k, *r[1:]) for k, r in enumerate(rows)])], f"{PRINT}, pos long")
    old = items.where("id % 4 = 0 and id < 100")
    found = publish.assemble_issue(items, old, [F.col("pos")]).select("id", "component").collect()
    assert len(made) == 1 and sorted(label for label, whole in written if whole) == ["classes", "issue"]
    prints = items.select("id", "title", "body", "nums", "day")
    clusters = {r.id: r.component for r in publish.cluster(prints, context=old.drop("pos")).collect()}
    seen = {clusters[r.id] for r in publish.published_matches(prints, old).collect()}
    assert sorted((r.component, r.id) for r in found) == sorted((c, min(i for i in clusters if clusters[i] == c)) for c in set(clusters.values()) - seen)
    assert {100, 101, 198 + len(rows), 199 + len(rows)} <= {r.id for r in found} and len(seen) > 3
