import pytest

from eventsieve.operators import similarity
from eventsieve.plans.tables import materialize
from eventsieve.sources import files
from tests.test_similarity import PRINT, cards


def test_small_groups_need_no_keys(spark, monkeypatch):
    grouped = materialize(similarity.classes(spark.createDataFrame(cards(51, 40), PRINT)), "classes")
    told = grouped.selectExpr("class_id % 4 AS g", "class_id")
    rows = lambda: sorted(similarity.similar_within(told, grouped, similarity.MODEL_FLOOR).collect())
    with monkeypatch.context() as patched:
        patched.setattr(similarity, "MEMBERS", 1, raising=False)
        by_keys = rows()
    monkeypatch.setattr(similarity, "keys", lambda *_: pytest.fail("rows for keys"))
    assert rows() == by_keys and len(by_keys) > 5


def test_the_driver_lists_no_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LISTED", 3, raising=False)
    told = [(f"{i % 3}/{i} x/index.html", f"page {i}") for i in range(20)]
    files.write_pages(spark.createDataFrame(told, "path string, html string"), str(tmp_path), "path", "html")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "index.html").write_text("no")
    pages = files.read_pages(spark, str(tmp_path))
    assert sorted(map(tuple, pages.collect())) == sorted(told)
    assert not any(f.endswith("index.html") for f in pages.inputFiles())
