import pytest
from pyspark.sql import functions as F

from eventsieve.sources import files


def test_arrays_keep_rows_and_order(spark, tmp_path):
    rows = [(i, i % 3, f"{i:02d}.01.2024" if i % 4 else None, f'"{i}"\n[x], й', None, "") for i in (7, 0, 3, 12, 1, 5, 2)]
    cards = spark.createDataFrame(rows, "at int, issue int, date string, title string, extract string, url string")
    path = str(tmp_path / "cards")
    files.write_arrays(cards, path, "at", 5)
    found = files.read_cards(spark, path, lines=True).collect()
    assert sorted((r.title, r.issue, r.date, r.extract, r.url) for r in found) == sorted((r[3], r[1], r[2], None, "") for r in rows)
    # 0, 1, 2, 3 stand in one array, 5 and 7 in the next, then 12
    assert {r.title.split('"')[1]: r.pos for r in found} == {"0": 0, "1": 1, "2": 2, "3": 3, "5": 0, "7": 1, "12": 0}
    files.write_arrays(cards.limit(0), path, "at")
    assert files.read_cards(spark, path, lines=True).count() == 0
    assert files.read_catalogue(spark, path, lines=True).count() == 0


def test_page_tree(spark, tmp_path):
    rows = [("index.html", "<p>й\r\n</p>"), ("a/index.html", "x" * 300_000), ("a/b/index.html", None), (None, "lost"), ("a/other.html", "y")]
    pages = spark.createDataFrame(rows, "path string, html string")
    for root in (str(tmp_path / "one"), f"file:{tmp_path}/two", f"file://{tmp_path}/three/"):
        assert files.write_pages(pages, root, "path", "html") == 4
        assert files.write_pages(pages, root, "path", "html") == 4
        found = {r.path: r.html for r in files.read_pages(spark, root).collect()}
        assert found == {"index.html": rows[0][1], "a/index.html": rows[1][1]}  # an empty file gives no row
    assert files.write_pages(pages.limit(0), str(tmp_path / "none"), "path", "html") == 0
    for path in ("/etc/x", "a/../../x", ".."):
        with pytest.raises(Exception, match="out of the tree"):
            files.write_pages(pages.limit(1).withColumn("path", F.lit(path)), str(tmp_path / "bad"), "path", "html")


def test_feed_and_sitemap(spark, tmp_path):
    items = spark.createDataFrame([("A & <b>", "https://s.example/?a=1&b=2", "1", "Mon", ["one", "two"]), (None, None, None, None, [])],
        "title string, link string, guid string, pubDate string, headlines array<string>")
    files.write_feed(items, str(tmp_path / "feed"))
    found = files.read_feed(spark, str(tmp_path / "feed")).collect()
    assert {(r.title, r.link, r.guid and r.guid._VALUE, tuple(r.headlines)) for r in found} == {
        ("A & <b>", "https://s.example/?a=1&b=2", "1", ("one", "two")), (None, None, None, ())}
    pages = spark.range(5).select(F.concat(F.lit("https://s.example/?p=1&n="), "id").alias("url"))
    more = {"loc": F.col("url"), "lastmod": F.lit(None).cast("date"), "changefreq": F.lit("daily"), "priority": F.lit(1.0)}
    files.write_sitemap(pages.limit(3).withColumns(more), str(tmp_path / "map"))
    assert files.unlisted_pages(pages, files.read_sitemap(spark, str(tmp_path / "map"))).count() == 2


def test_no_xml_file_holds_more_rows_than_a_task_should_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_A_FILE", 4, raising=False)
    ids = spark.range(0, 10, 1, 1)
    text = F.col("id").cast("string")
    files.write_feed(ids.select(*[text.alias(c) for c in ("title", "link", "guid", "pubDate")], F.array(text).alias("headlines")), str(tmp_path / "feed"))
    more = {"lastmod": F.lit(None).cast("date"), "changefreq": F.lit("daily"), "priority": F.lit(1.0)}
    files.write_sitemap(ids.select(text.alias("loc")).withColumns(more), str(tmp_path / "map"))
    for kind, found in (("feed", files.read_feed(spark, str(tmp_path / "feed"))), ("map", files.read_sitemap(spark, str(tmp_path / "map")))):
        assert len(list((tmp_path / kind).glob("part-*"))) == 3 and found.count() == 10
