import datetime
import html
import json

from pyspark.sql import functions as F

from eventsieve.operators import knowledge, visitors
from eventsieve.sources import files

PAGE = """<html lang="en"><head><title> Pollock &amp; Co </title><meta name="description" content="Frozen &quot;fish&quot;">
</head><body><h1>Frozen <b>pollock</b></h1><article><script>x("</p>")</script><table><tr><td>Size</td><td>25 cm</td></tr></table>
<p>First   line<br/>second</p><form><p>gone</p></form><h2>How it works</h2><p>cut</p></article>
<details><summary>Is it <i>frozen</i>?</summary><p>Yes &amp; no</p></details></body></html>"""


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_knowledge_from_a_tree_of_pages(spark, tmp_path):
    site = tmp_path / "site"
    write(site, "index.html", PAGE)
    write(site, "fish/index.html", PAGE)
    write(site, "privacy/index.html", PAGE)
    write(site, "hidden/index.html", '<meta name="robots" content="noindex,follow">' + PAGE)
    write(site, "bare/index.html", "<p>nothing else</p>")
    write(site, "fish/other.html", PAGE)
    pages = files.read_pages(spark, str(site))
    assert {r.path for r in pages.collect()} == {f"{d}index.html" for d in ("", "fish/", "privacy/", "hidden/", "bare/")}
    kept = knowledge.kept_paths(pages, "path")
    for entities in (knowledge.common_unescape, knowledge.unescape):
        found = {r.path: r for r in knowledge.page_records(kept, F.col("html"), "path", entities).collect()}
        assert set(found) == {"fish/index.html", "bare/index.html"}
        fish = found["fish/index.html"]
        assert (fish.lang, fish.title, fish.description, fish.h1) == ("en", "Pollock & Co", 'Frozen "fish"', "Frozen pollock")
        assert fish.facts == "Size | 25 cm\nFirst line\nsecond" and fish.quarantine_reason is None
        assert [tuple(x) for x in fish.faq] == [("Is it frozen?", "Yes & no")]
        assert found["bare/index.html"].quarantine_reason == "no lang,no title,no description,no h1"
    catalogue = [{"slug": "pollock", "page_url": "/fish/", "meta_html": "x", "products": ["a"], "show_name": False}, {"slug": "y"}]
    write(tmp_path, "directions.json", json.dumps(catalogue))
    listed = knowledge.enriched_catalogue(files.read_catalogue(spark, str(tmp_path / "directions.json")), "https://s.example")
    assert [(r.slug, r.page_url) for r in listed.collect()] == [("pollock", "https://s.example/fish/"), ("y", "")]
    records = knowledge.page_records(kept, F.col("html"), "path").withColumn("url", knowledge.page_url(F.col("path"), "https://s.example"))
    lines = knowledge.knowledge_lines(records, listed, "About", ("Rule",))
    assert files.write_document(lines, str(tmp_path / "document")) == (2, 2)
    document = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "document").glob("part-*"))))
    nothing = knowledge.knowledge_lines(records.limit(0), listed.limit(0), "A", ()).orderBy("part", "key").collect()
    assert json.loads("".join(r.line for r in nothing)) == {"about": "A", "rules": [], "directions": [], "pages": []}
    twice = knowledge.knowledge_lines(records.union(records), listed, "A", ()).orderBy("part", "key").collect()
    assert len(json.loads("".join(r.line for r in twice))["pages"]) == 4
    assert document["about"] == "About" and document["rules"] == ["Rule"]
    assert [p["url"] for p in document["pages"]] == ["https://s.example/bare/", "https://s.example/fish/"]
    assert document["directions"][0]["slug"] == "pollock" and "meta_html" not in document["directions"][0]
    files.write_knowledge(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_xml_and_card_sources(spark, tmp_path):
    feed = """<rss><channel><item><title>T</title><link>https://a/</link><guid isPermaLink="false">g</guid><pubDate>x</pubDate>
    <description>&lt;ul&gt;&lt;li&gt;One &lt;b&gt;two&lt;/b&gt;&lt;/li&gt;&lt;li&gt;Three&lt;/li&gt;&lt;/ul&gt;</description></item></channel></rss>"""
    write(tmp_path, "feed.xml", feed)
    item = files.read_feed(spark, str(tmp_path / "feed.xml")).first()
    assert item.headlines == ["One two", "Three"] and item.guid["_isPermaLink"] is False
    write(tmp_path, "sitemap.xml", "<urlset><url><loc>https://a/</loc><lastmod>2026-10-01</lastmod><priority>0.5</priority></url></urlset>")
    listed = files.read_sitemap(spark, str(tmp_path / "sitemap.xml"))
    assert listed.first().lastmod == datetime.date(2026, 10, 1)
    pages = spark.createDataFrame([("https://a/",), ("https://b/",)], "url string")
    assert [r.url for r in files.unlisted_pages(pages, listed).collect()] == ["https://b/"]
    write(tmp_path, "cards.json", json.dumps([{"issue": 2, "title": "B"}, {"issue": 1, "title": "A"}]))
    assert [(r.pos, r.title) for r in files.read_cards(spark, str(tmp_path / "cards.json")).orderBy("pos").collect()] == [(0, "B"), (1, "A")]


def test_attribution(spark):
    rows = [
        (1, 1, {}, ""), (1, 2, {"utm_source": "a", "utm_term": "t"}, "ref1"), (1, 3, {}, "ref2"), (1, 4, {"utm_source": "b"}, None),
        (2, 1, {}, None),
    ]
    table = spark.createDataFrame(rows, "s int, ts int, campaign map<string,string>, referrer string")
    found = visitors.attributed(table, "s", ["ts"], "campaign", "referrer").orderBy("s", "ts").collect()
    assert [r.last_touch for r in found] == [None, rows[1][2], rows[1][2], {"utm_source": "b"}, None]
    assert [r.first_referrer for r in found] == [None, "ref1", "ref1", "ref1", None]


def test_files_and_shown_texts(spark):
    from eventsieve.functions import urls

    links = [("a.PDF?x=1",), ("mailto:a@b.c/x.pdf",), ("https://wa.me/1",), ("x.html",), (None,)]
    table = spark.createDataFrame(links, "href string")
    found = table.select(urls.click_goal(F.col("href")), urls.click_file(F.col("href"))).collect()
    assert [tuple(r) for r in found] == [("download", "a.PDF?x=1"), ("email_click", None), ("whatsapp_click", None), (None, None), (None, None)]
    rows = [({"topic": "t1", "name": " Ann "}, {"topic": " Fish and more "}), ({"topic": "t2", "name": ""}, {"topic": ""}), ({"topic": "t3"}, None)]
    leads = spark.createDataFrame(rows, "fields map<string,string>, texts map<string,string>").withColumns(
        {"form": F.lit("f"), "page": F.lit("p"), "lang": F.lit("en"), "ref": F.lit(""), "utm": F.create_map().cast("map<string,string>")}
    )
    out = visitors.lead_records(leads, "fields", {"topic": "Topic"}, "form", "page", "lang", "ref", "utm", texts="texts").collect()
    assert [r.raw["topic"] for r in out] == ["t1", "t2", "t3"]
    assert [r.display.get("Topic") for r in out] == ["Fish and more", None, "t3"] and out[0].display["name"] == "Ann"


def test_leads(spark):
    rows = [
        (1, " Ann ", "a@b.co", True, ""), (2, " ", "bad", True, ""), (3, "Bob", "", False, "x"), (4, "Eve", "e@e.org", True, "bot"), (5, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "id int, name string, email string, consent boolean, trap string")
    errors = visitors.lead_errors({"name": F.col("name")}, {"email": F.col("email")}, {"consent": F.col("consent")})
    valid, wrong = visitors.checked_leads(table, errors, "trap")
    assert [r.id for r in valid.collect()] == [1] and "trap" not in valid.columns + wrong.columns
    assert {r.id: [tuple(e) for e in r.errors] for r in wrong.collect()} == {
        2: [("name", "required"), ("email", "email")], 3: [("consent", "consent")], 5: [("name", "required"), ("consent", "consent")],
    }
    attempts = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None)], "lead int, ok boolean")
    assert {r.lead: r.delivered for r in visitors.delivered(attempts, "lead", "ok").collect()} == {1: True, 2: False}


def test_sessions_logs_and_ids(spark):
    at = datetime.datetime(2026, 1, 1)
    hours = [(1, 0, False), (1, 720, True), (1, 732, False), (1, 744.1, True), (1, 756.2, False), (1, 1500, False), (2, 5, False)]
    rows = [(v, n, at + datetime.timedelta(hours=h), c) for n, (v, h, c) in enumerate(hours)]
    table = spark.createDataFrame(rows, "v int, n int, ts timestamp, closed boolean")
    found = visitors.sessions(table, "v", "ts", F.col("closed"), "n").orderBy("n").collect()
    assert [r.session for r in found] == [1, 1, 1, 1, 2, 3, 1]
    log = spark.createDataFrame([(1, t, "me" if t % 2 else "bot", f"m{t}") for t in range(5)], "c int, t int, who string, text string")
    assert sorted(r.t for r in visitors.capped_log(log, "c", "t", 2).collect()) == [3, 4]
    last = visitors.with_history(log, "c", "t", F.col("who"), "text", 2).where("t = 4").first()
    assert [tuple(h) for h in last.history] == [("assistant", "m2"), ("user", "m3")]
    ids = spark.createDataFrame([("a" * 24,), ("A" * 24,), (None,)], "sid string")
    assert [x.count() for x in visitors.split_session_ids(ids, "sid")] == [1, 2]


def test_entities_are_read_as_html_does(spark):
    texts = [
        "caf&eacute; &hellip; it&#8217;s &#x27;q&#x27; &copy; 1", "&amp;lt; &amp;amp; &nbsp;&quot;", "a & b && c &; &# &", "&copy 2024 &ampx &notit; &#39 &#x",
        "&middot; &ndash; &mdash; &apos;&lt;&gt;", "&COPY; &Quot;", "&unknown; &", "plain", "", None, "x &\n&amp;\r&copy",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    expected = [t if t is None else html.unescape(t) for t in texts]
    assert [r[0] for r in rows.select(knowledge.decoded(F.col("t"))).collect()] == expected


def test_page_queries_read_all_entities(spark, tmp_path):
    from eventsieve import queries

    page = (
        '<html lang="en"><head><title>Caf&eacute;</title><meta name="description" content="It&#8217;s"></head><body>'
        "<article><h1>More&hellip;</h1><p>&#x27;A&#x27; &amp; B</p><details><summary>Wh&agrave;t?</summary><p>&euro;5</p></details></article></body></html>"
    )
    pages = spark.createDataFrame([(1, "https://a.example/x", page)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.page_fields(spark, str(tmp_path)).first()
    assert (found.title, found.description, found.h1) == ("Café", "It’s", "More…")
    record = queries._page_records(spark, str(tmp_path)).first()
    assert "'A' & B" in record.facts and (record.faq[0].q, record.faq[0].a) == ("Whàt?", "€5")
    asked = {r.q: r.a for r in queries.page_faq(spark, str(tmp_path)).collect()}
    assert asked["Whàt?"] == "€5" and asked["About Café?"] == "See page 1 & more"
