import pytest
from pyspark.sql import functions as F

from eventsieve.llm import simhash
from eventsieve.plans.tables import materialize


@pytest.fixture
def plans(monkeypatch):
    found, write = {}, simhash.materialize

    def recorded(df, label):
        found[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", recorded)
    return found


def test_variants_are_not_broadcast(spark, plans):
    """The table of variants has 64 rows a fingerprint, whatever size Spark takes it for."""
    marks = [5, 7, 6 << 40, 1 << 63 - 1]
    fps = materialize(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in marks], "fp long"), "fps")
    assert {(r.a, r.b) for r in simhash.links(fps).select(F.col("a"), F.col("b")).collect()} == {(5, 7)}
    assert "SortMergeJoin" in plans["variants"] and "Broadcast" not in plans["variants"]


def test_the_pipelines_stage_broadcasts_no_variants(spark, plans):
    import corpus_pipeline

    docs = materialize(spark.createDataFrame([(i, f"some text of its own {i % 3} {i % 3} {i % 3}") for i in range(9)], "doc_id long, text string"), "docs")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [0, 1, 2]
    assert "SortMergeJoin" in plans["variants"] and "Broadcast" not in plans["variants"]
