"""The registered queries of the core library, over the driver's tables.

documents stand in for articles: the first 12 words are the title, the text is
the extract, the day is 2024-01-01 plus doc_id mod 30, the issue is doc_id mod 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventsieve.functions import lexicon, text, urls
from eventsieve.operators import knowledge, publish, similarity, visitors
from eventsieve.plans.tables import materialize, shared_path, spread, table
from eventsieve.sources import files

SITE_RULES = lexicon.Lexicon(primary_domains=("example.org",), aggregator_domains=("spam", "cheap-"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("pos"),
        (F.col("doc_id") % 5).alias("issue"),
        text.lead(F.col("text"), 12).alias("headline"),
        F.col("text").alias("extract"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        "lang",
        "source",
    )


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, written once."""
    items = _articles(spark, sf_dir)
    columns = (F.col("headline"), F.col("extract"), F.col("date"))
    return materialize(similarity.fingerprints(items, "id", *columns), "prints")


def fold_words(spark, sf_dir):
    found = F.sort_array(text.words(F.col("text")))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size(found).alias("n_words"), F.md5(F.array_join(found, " ").cast("binary")).alias("words_md5")
    )


def stem_tokens(spark, sf_dir):
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")
    counted = table(spark, sf_dir, "documents").select(tokens).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return counted.select("token", text.stem(F.col("token")).alias("stem"), "uses")


def phrase_canon(spark, sf_dir):
    told = F.concat(F.lit("Tonnes of record-high Shipments: European Union raises cuts. "), F.col("text"))
    canon = text.with_phrases(text.fold(told))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.length(canon).alias("n_chars_canon"), F.md5(canon.cast("binary")).alias("canon_md5")
    )


def anchors_numbers(spark, sf_dir):
    told = F.concat_ws(
        "",
        F.lit("Paid $"), (F.col("l_extendedprice") / 10).cast("decimal(15,1)").cast("string"), F.lit("M for "),
        F.col("l_quantity").cast("int").cast("string"), F.lit(" million units in 1998 at "),
        F.col("l_linenumber").cast("string"), F.lit(",500% or x9.5 on line "), F.col("l_linenumber").cast("string"),
    )
    found = F.sort_array(text.anchors(told))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return spread(lines).select(
        "l_orderkey", "l_linenumber", F.array_join(found, ",").alias("anchors")
    )


def parse_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    told = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "dd.MM.yyyy"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:09:10+03:00")))
        .when(F.col("o_orderkey") % 5 == 3, F.lit("31.02.2024"))
        .otherwise(F.lit("soon"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.any_date(told).alias("parsed"))


def source_rank_hosts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.bare_host(url).alias("host"), urls.source_rank(url, SITE_RULES).alias("source_rank")
    )


def token_df_idf(spark, sf_dir):
    n, counts = similarity.corpus(similarity.classes(_prints(spark, sf_dir)))
    return counts.select("token", "df", F.round(similarity.weight(F.lit(n), F.col("df")), 9).alias("idf"))


def doc_weights(spark, sf_dir):
    grouped = materialize(similarity.classes(_prints(spark, sf_dir)), "classes")
    n, counts = similarity.corpus(grouped)
    sets = similarity.weighted(grouped, counts, {"w": lambda df: similarity.weight(F.lit(n), df)})
    return sets.select(
        "class_id", "size", F.round("title_w", 6).alias("title_weight"), F.round("body_w", 6).alias("body_weight")
    )


def _pairs(spark, sf_dir, with_context: bool):
    prints = _prints(spark, sf_dir)
    context = None
    if with_context:
        of = _articles(spark, sf_dir).where("source = 'src1'").select("id")
        context, prints = prints.join(of, "id", "left_semi"), prints.join(of, "id", "left_anti")
    grouped = materialize(similarity.classes(prints), "classes")
    found = similarity.similar_classes(grouped, 7, similarity.THRESHOLD, context)
    return found.select("a_id", "b_id", F.round("score", 6).alias("score"))


def similar_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, False)


def similar_pairs_context(spark, sf_dir):
    return _pairs(spark, sf_dir, True)


def near_dup_components(spark, sf_dir):
    return publish.cluster(_prints(spark, sf_dir))


def _clustered(spark, sf_dir) -> DataFrame:
    """Articles with their component and what ranks them."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pid"), "url")
    found = publish.cluster(_prints(spark, sf_dir)).withColumnRenamed("id", "own")
    items = _articles(spark, sf_dir).withColumn("n_chars", F.length("extract")).drop("extract", "headline")
    return materialize(
        items.join(found, F.col("id") == F.col("own"))
        .join(pages, F.col("id") == F.col("pid"), "left")
        .select("id", "pos", "component", "n_chars", "url", urls.source_rank(F.col("url"), SITE_RULES).alias("source_rank")),
        "clustered",
    )


def _rank():
    return [F.col("source_rank"), -F.col("n_chars")]


def cluster_primary(spark, sf_dir):
    return publish.primaries(_clustered(spark, sf_dir), _rank()).select(
        "component", "size", F.col("id").alias("primary_id"), "source_rank", "url"
    )


def also_reported(spark, sf_dir):
    return publish.also_reported(_clustered(spark, sf_dir), _rank(), "id")


def _split(spark, sf_dir):
    """Fingerprints to publish, and those published before (doc_id divisible by 5)."""
    prints = _prints(spark, sf_dir)
    return prints.where("id % 5 <> 0"), prints.where("id % 5 = 0").withColumn("pos", F.col("id"))


def already_published_best(spark, sf_dir):
    fresh, old = _split(spark, sf_dir)
    return publish.published_matches(fresh, old).select("id", "old_id", F.round("score", 6).alias("score"))


def _repeats(spark, sf_dir):
    fresh, old = _split(spark, sf_dir)
    found = publish.cluster(fresh).withColumn("pos", F.col("id"))
    items = materialize(publish.ranked(found, []), "ranked")
    return publish.split_repeats(items, materialize(publish.published_matches(fresh, old), "matches"))


def drop_repeats_fresh(spark, sf_dir):
    return _repeats(spark, sf_dir)[0].select("component", "id", F.col("ord").cast("int").alias("ord"))


def drop_repeats_repeats(spark, sf_dir):
    return _repeats(spark, sf_dir)[1]


def exact_repeats(spark, sf_dir):
    return publish.exact_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def exact_repeats_links(spark, sf_dir):
    """Pages whose folder, as the link, or whose text was there before; each fifth page is the history."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", "^[^?#]*/", 0).alias("link"))
    fresh, old = pages.where("page_id % 5 <> 0"), pages.where("page_id % 5 = 0")
    return publish.exact_repeats(fresh, "page_id", "html", "link", old)


def _issues(spark, sf_dir, issue, look_back_days=None):
    """What each issue publishes; of a cluster the longest text."""
    ranked = _articles(spark, sf_dir).select("id", "pos", issue.alias("issue"), (-F.length("extract")).alias("longest"))
    items = materialize(_prints(spark, sf_dir).join(ranked, "id"), "items")
    return publish.publish_issues(items, "issue", [F.col("longest")], look_back_days)


def issue_loop_shown(spark, sf_dir):
    return _issues(spark, sf_dir, F.col("issue")).groupBy("issue").agg(F.count_distinct("component").alias("shown"))


def issue_loop_look_back(spark, sf_dir):
    """Issues of six days, which see the history of the three days before only."""
    issue = F.expr("(id % 30) div 6")
    return _issues(spark, sf_dir, issue, 3).select("issue", "id")


def verdict_parse(spark, sf_dir):
    """A model's answers as they come: whole, with text around, broken, with wrong numbers."""
    n = F.col("doc_id")
    answer = (
        F.when(n % 4 == 0, F.format_string('Sure: {"groups": [[%d, 2, 2], [3, "4"]]} done', n % 7 + 1))
        .when(n % 4 == 1, F.lit("not json"))
        .when(n % 4 == 2, F.format_string('{"groups": [["a", 99, %d]]}', n % 5))
        .otherwise(F.lit('{"groups": []}'))
    )
    groups = publish.verdict_groups(answer, F.lit(10))
    shown = F.array_join(F.transform(groups, lambda g: F.array_join(g.cast("array<string>"), "+")), ";")
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("groups"))


def _heads(prints: DataFrame) -> DataFrame:
    """(n, component): the first article of each cluster."""
    return materialize(publish.cluster(prints).groupBy("component").agg(F.min("id").alias("n")).select("n", "component"), "heads")


def prompt_lines(spark, sf_dir):
    """Lines of batches of ten neighbours among the first articles of the clusters."""
    heads = _heads(_prints(spark, sf_dir)).select(F.col("n").alias("own"))
    batch = F.floor(F.col("id") / 10)
    items = _articles(spark, sf_dir).join(heads, F.col("id") == F.col("own"))
    numbered = items.withColumn("number", F.row_number().over(Window.partitionBy(batch).orderBy("id")))
    keys = F.struct(batch.alias("batch"), "number").alias("place")
    lines = publish.prompt_lines(numbered.withColumn("place", keys), "place.number", "headline", "extract", "date", "place.batch")
    return lines.select("batch", "number", "line")


def verdict_merge(spark, sf_dir):
    """Components after verdicts that group each ten neighbours among the primaries."""
    prints = _prints(spark, sf_dir)
    heads = _heads(prints)
    groups = heads.groupBy(F.floor(F.col("n") / 10).alias("ten")).agg(F.array_sort(F.collect_list("n")).alias("group"))
    return publish.merged_components(heads, prints.join(heads.select(F.col("n").alias("id")), "id"), groups)


def verdict_fallback(spark, sf_dir):
    """The same where a third of the answers is missing and a third can't be read: these leave the components as they are."""
    prints = _prints(spark, sf_dir)
    heads = _heads(prints)
    ten = F.floor(F.col("n") / 10)
    batches = heads.groupBy(ten.alias("ten")).agg(F.array_sort(F.collect_list("n")).alias("ns"))
    # an answer numbers the heads of its batch from 1
    all_of = F.concat(F.lit('Sure: {"groups": [['), F.array_join(F.sequence(F.lit(1), F.size("ns")), ", "), F.lit("]]}"))
    answer = F.when(F.col("ten") % 3 == 1, F.left(all_of, F.length(all_of) - 2)).when(F.col("ten") % 3 == 2, all_of)
    told = batches.select("ns", F.explode(publish.verdict_groups(answer, F.size("ns"))).alias("told"))
    groups = told.select(F.transform("told", lambda i: F.get("ns", i)).alias("group"))
    return publish.merged_components(heads, prints.join(heads.select(F.col("n").alias("id")), "id"), groups)


def cluster_audit(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return publish.audit(near_dup_components(spark, sf_dir).join(labels, "id"), F.col("quality"))


def cluster_pair_quality(spark, sf_dir):
    clusters = near_dup_components(spark, sf_dir)
    source = _articles(spark, sf_dir).select("id", "source")
    found = publish.pair_quality(clusters.join(source, "id"), F.col("source"))
    return found.select("clustered", "labelled", "both", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def benchmark_overlap(spark, sf_dir):
    tests = table(spark, sf_dir, "benchmark")
    none = F.lit(None).cast("date")
    old = similarity.fingerprints(tests, "item_id", text.lead(F.col("text"), 12), F.col("text"), none)
    old = materialize(old.withColumn("pos", F.col("id")), "tests")
    found = publish.published_matches(_prints(spark, sf_dir), old)
    return found.select("id", "old_id", F.round("score", 6).alias("score"))


def _page_records(spark, sf_dir):
    return knowledge.page_records(table(spark, sf_dir, "pages"), F.col("html"), "page_id")


def page_fields(spark, sf_dir):
    return _page_records(spark, sf_dir).select("page_id", "lang", "title", "description", "h1", "quarantine_reason")


def page_text(spark, sf_dir):
    facts = F.col("facts")
    return _page_records(spark, sf_dir).select(
        "page_id", F.length(facts).alias("n_chars"), F.md5(facts.cast("binary")).alias("facts_md5")
    )


def page_faq(spark, sf_dir):
    """The pages hold no questions: each gets one made of its title and one fixed."""
    more = F.concat(
        F.lit("<details><summary>About "), F.regexp_extract("html", r"<title>([^<]*)</title>", 1),
        F.lit("?</summary><p>See <b>page</b> "), F.col("page_id").cast("string"),
        F.lit(" &amp; more</p></details><summary>Q</summary><p>A</p>"),
    )
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.col("html"), more))
    asked = knowledge.questions(F.col("html"))
    return pages.select("page_id", F.posexplode(asked).alias("pos", "qa")).select("page_id", "pos", "qa.q", "qa.a")


def page_knowledge(spark, sf_dir):
    """Facts by language and host, of pages whose path the skip list passes."""
    pages = table(spark, sf_dir, "pages").withColumn("path", _site_path())
    kept = knowledge.kept_paths(pages, "path", skipped=("en/1", "de/2"))
    found = knowledge.page_records(kept, F.col("html"), "page_id")
    return found.groupBy("lang").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("facts")).alias("fact_chars"), F.max("title").alias("last_title")
    )


def _site_path() -> Column:
    return F.concat(F.regexp_extract("url", r"://[^/]+/([^?#]*)", 1), F.lit("/index.html"))


def page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", knowledge.page_url(_site_path(), "https://site.example").alias("page_url"))


def _catalogue(spark, sf_dir) -> DataFrame:
    """Parts as products, each third without a page."""
    page = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"), F.lit("/#top")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), page.alias("page_url"))
    return knowledge.enriched_catalogue(parts.withColumn("meta_html", F.lit("<meta>")), "https://site.example")


def catalogue_urls(spark, sf_dir):
    return _catalogue(spark, sf_dir)


def _document(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("url", knowledge.page_url(_site_path(), "https://site.example"))
    found = knowledge.page_records(pages, F.col("html"), "url").select("url", F.md5(F.col("facts").cast("binary")).alias("facts"))
    return knowledge.knowledge_lines(found, _catalogue(spark, sf_dir), "About", ("Rule",))


def knowledge_lines(spark, sf_dir):
    """The lines of the document of all pages and products: parts, keys, and what their text digests to."""
    return _document(spark, sf_dir).select("part", F.regexp_replace("line", "^,", "").alias("line"))


def knowledge_document(spark, sf_dir):
    """The document as it stands in its files."""
    path = shared_path(spark, "document")
    files.write_document(_document(spark, sf_dir), path)
    return spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("line"))


def knowledge_counts(spark, sf_dir):
    """How many pages and directions the document was written with, counted while it was."""
    pages, directions = files.write_document(_document(spark, sf_dir), shared_path(spark, "document"))
    return spark.createDataFrame([("pages", pages), ("directions", directions)], "kind string, entries long")


def cards_json(spark, sf_dir):
    """All articles written as JSON arrays of cards and read back."""
    path = shared_path(spark, "cards")
    cards = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % 5).cast("int").alias("issue"), F.col("source").alias("title"), F.col("text").alias("extract"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "dd.MM.yyyy").alias("date"),
        F.concat(F.lit("https://site.example/"), F.col("doc_id")).alias("url"),
    )
    files.write_arrays(cards, path, "doc_id", 100)
    found = files.read_cards(spark, path, lines=True)
    return found.select("url", "pos", "issue", "date", "title", F.md5(F.col("extract").cast("binary")).alias("extract_md5"))


def catalogue_json(spark, sf_dir):
    """All parts written as JSON arrays of catalogue entries and read back."""
    path = shared_path(spark, "catalogue")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("title_en"), F.col("p_type").alias("category"),
        F.array("p_brand", "p_type").alias("products"), (F.col("p_size") > 25).alias("show_name"),
        F.array(F.struct(F.col("p_brand").alias("text"), F.concat(F.lit("https://site.example/"), F.col("p_partkey")).alias("url"))).alias("import_notes"),
    )
    files.write_arrays(parts, path, "p_partkey", 500)
    note = F.col("import_notes")[0]
    return files.read_catalogue(spark, path, lines=True).select(
        "slug", "title_en", "category", F.array_join("products", "|").alias("products"), "show_name",
        note["text"].alias("note"), note["url"].alias("note_url"), F.col("moq").isNull().alias("no_moq"),
    )


def page_tree(spark, sf_dir):
    """All pages written as a tree of index.html files and read back."""
    root = shared_path(spark, "tree")
    pages = table(spark, sf_dir, "pages").select(F.format_string("%d/%d/index.html", F.col("page_id") % 10, F.col("page_id")).alias("path"), "html")
    files.write_pages(spread(pages), root, "path", "html")
    return files.read_pages(spark, root).select("path", F.md5(F.col("html").cast("binary")).alias("html_md5"))


def published_history(spark, sf_dir):
    """Articles published in two runs, the second of which replaces one issue of the first."""
    path = shared_path(spark, "history")
    items = _articles(spark, sf_dir).select("id", "source", "date", "issue")
    files.append_history(items.where("issue < 3").withColumn("run", F.lit(1)), path)
    files.append_history(items.where("issue >= 2").withColumn("run", F.lit(2)), path)
    return files.read_history(spark, path, items.withColumn("run", F.lit(1)).schema).select("issue", "id", "source", "date", "run")


def feed_rss(spark, sf_dir):
    """All parts written as items of a feed and read back."""
    path = shared_path(spark, "feed")
    link = F.concat(F.lit("https://site.example/?a=1&b="), F.col("p_partkey"))
    items = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("title"), link.alias("link"), F.col("p_partkey").cast("string").alias("guid"),
        F.lit("Mon, 01 Jan 2024 08:00:00 +0800").alias("pubDate"), F.array("p_brand", "p_type").alias("headlines"),
    )
    files.write_feed(items, path)
    return files.read_feed(spark, path).select(
        F.col("guid._VALUE").alias("guid"), "title", "link", "pubDate", F.array_join("headlines", "|").alias("headlines")
    )


def sitemap_unlisted(spark, sf_dir):
    """Pages that a site map of all but each seventh doesn't name."""
    path = shared_path(spark, "sitemap")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"))
    listed = pages.where("page_id % 7 <> 0").select(
        F.col("url").alias("loc"), F.lit("2024-01-01").cast("date").alias("lastmod"), F.lit("weekly").alias("changefreq"), F.lit(0.5).alias("priority")
    )
    files.write_sitemap(listed, path)
    return files.unlisted_pages(pages, files.read_sitemap(spark, path)).select("page_id", "url")


def utm_extract(spark, sf_dir):
    found = urls.utm(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(found).alias("n_keys"), F.try_element_at(found, F.lit("utm_source")).alias("utm_source")
    )


def _landings(spark, sf_dir) -> DataFrame:
    """Events of a visitor, each on the page its id picks."""
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    pages = pages.select(F.col("page_id").alias("on_page"), "url")
    events = table(spark, sf_dir, "events")
    return events.join(pages, F.col("event_id") % n == F.col("on_page")).select(
        "event_id", "user_id", "ts",
        F.map_filter(urls.utm(F.col("url")), lambda k, v: F.col("event_type") != "error").alias("campaign"),
        F.when(F.col("event_type") == "click", urls.bare_host(F.col("url"))).otherwise("").alias("referrer"),
    )


def _attributed(spark, sf_dir):
    rows = visitors.attributed(_landings(spark, sf_dir), "user_id", ["ts", "event_id"], "campaign", "referrer")
    return rows.withColumn("utm_source", F.try_element_at("last_touch", F.lit("utm_source")))


def last_touch(spark, sf_dir):
    return _attributed(spark, sf_dir).select("event_id", "utm_source")


def first_referrer(spark, sf_dir):
    return _attributed(spark, sf_dir).select("event_id", "first_referrer")


def _hrefs() -> Column:
    n, url = F.col("page_id"), F.col("url")
    return (
        F.when(n % 5 == 0, F.concat(F.lit("MAILTO:a@"), urls.bare_host(url)))
        .when(n % 5 == 1, F.concat(F.lit("https://wa.me/"), n.cast("string")))
        .when(n % 5 == 2, F.concat(url, F.lit(".pdf")))
        .otherwise(url)
    )


def click_files(spark, sf_dir):
    href = _hrefs()
    found = table(spark, sf_dir, "pages").select("page_id", urls.click_goal(href).alias("goal"), urls.click_file(href).alias("file"))
    return found.where("goal is not null")


def click_goals(spark, sf_dir):
    href = _hrefs()
    goals = table(spark, sf_dir, "pages").select(urls.click_goal(href).alias("goal"))
    return goals.groupBy(F.coalesce("goal", F.lit("none")).alias("goal")).agg(F.count(F.lit(1)).alias("clicks"))


def _leads(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    mail = (
        F.when(n % 7 == 0, "").when(n % 7 == 1, "no at sign").when(n % 7 == 2, "a@b.c")
        .otherwise(F.concat(F.lit("buyer"), n.cast("string"), F.lit("@example.com")))
    )
    return table(spark, sf_dir, "customer").select(
        n.alias("lead_id"),
        F.when(n % 11 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        mail.alias("email"),
        (n % 13 != 0).alias("consent"),
        F.when(n % 17 == 0, "bot").otherwise("").alias("trap"),
        F.col("c_mktsegment").alias("segment"),
    )


def lead_validation(spark, sf_dir):
    leads = _leads(spark, sf_dir)
    errors = visitors.lead_errors(
        {"name": F.col("name"), "email": F.col("email")}, {"email": F.col("email")}, {"consent": F.col("consent")}
    )
    shown = F.array_join(F.transform(errors, lambda e: F.concat_ws(":", e["field"], e["code"])), ",")
    valid, wrong = visitors.checked_leads(leads, errors, "trap")
    told = wrong.select("lead_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])), ",").alias("errors"))
    return told.union(valid.select("lead_id", F.lit("").alias("errors")))


def lead_records(spark, sf_dir):
    leads = _leads(spark, sf_dir).select(
        "lead_id",
        F.create_map(
            F.lit("company"), F.concat(F.lit(" "), F.col("name")), F.lit("email"), F.col("email"),
            F.lit("consent"), F.lit("yes"), F.lit("language"), F.lit("xx"),
        ).alias("fields"),
        F.lit("inquiry").alias("form_type"),
        F.concat(F.lit("https://example.com/p?x=1#"), F.col("lead_id").cast("string")).alias("page"),
        F.when(F.col("lead_id") % 2 == 0, "ru-RU").otherwise("en").alias("lang"),
        F.lit("").alias("referrer"),
        F.create_map(F.lit("utm_source"), F.lower("segment")).alias("campaign"),
    )
    out = visitors.lead_records(
        leads, "fields", {"company": "Company"}, "form_type", "page", "lang", "referrer", "campaign"
    )
    shown = lambda c: F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), "|"
    )
    return out.select("lead_id", shown("raw").alias("raw"), shown("display").alias("display"), "subject")


def lead_display_texts(spark, sf_dir):
    """The segment is a choice from a list: its code is kept raw, its text is shown."""
    leads = _leads(spark, sf_dir).select(
        "lead_id",
        F.create_map(F.lit("segment"), F.lower(F.left("segment", F.lit(3))), F.lit("email"), F.col("email")).alias("fields"),
        F.create_map(F.lit("segment"), F.concat("segment", F.lit(" "))).alias("texts"),
        F.lit("inquiry").alias("form_type"), F.lit("https://example.com/p").alias("page"), F.lit("en").alias("lang"),
        F.lit("").alias("referrer"), F.create_map().cast("map<string,string>").alias("campaign"),
    )
    out = visitors.lead_records(leads, "fields", {"segment": "Segment"}, "form_type", "page", "lang", "referrer", "campaign", texts="texts")
    return out.select(
        "lead_id",
        F.try_element_at("raw", F.lit("segment")).alias("raw_segment"),
        F.try_element_at("display", F.lit("Segment")).alias("shown_segment"),
        F.try_element_at("display", F.lit("email")).alias("shown_email"),
    )


def sessions_ttl(spark, sf_dir):
    closed = F.col("event_type") == "purchase"
    rows = visitors.sessions(table(spark, sf_dir, "events"), "user_id", "ts", closed, "event_id", idle_hours=24, closed_idle_hours=2)
    return rows.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


def capped_log(spark, sf_dir):
    return visitors.capped_log(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def history_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = visitors.with_history(rows, "conv_id", "turn", F.when(F.col("role") == "user", "me").otherwise("bot"), "text", 2)
    said = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["role"], F.length(h["text"]).cast("string"))), ",")
    return out.select("conv_id", "turn", said.alias("history"))


def retry_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return visitors.without_retries(events.union(events.where("event_id % 3 = 0")), ["user_id", "event_id"])


def error_rollup(spark, sf_dir):
    kind = visitors.failure_class(
        F.when(F.col("event_type") == "error", "AbortError"), F.when(F.col("event_type") != "error", F.col("event_type"))
    )
    out = visitors.failures_by_hour(table(spark, sf_dir, "events"), "ts", kind, F.col("value"))
    return out.select("hour", "kind", "failures", F.round("seconds", 6).alias("seconds"))


def delivery_status(spark, sf_dir):
    """Orders as leads, their line items as delivery attempts."""
    ok = F.col("l_returnflag") == "R"
    return visitors.delivered(table(spark, sf_dir, "lineitem").withColumn("ok", ok), "l_orderkey", "ok")


def delivery_within(spark, sf_dir):
    """Orders as leads, delivered if a line item was returned within 60 days."""
    leads = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_returnflag") == "R").alias("ok")
    )
    return visitors.delivered_within(leads, attempts, "o_orderkey", "at", "ok", 60 * 24)


def session_ids(spark, sf_dir):
    sid = F.left(F.md5(F.col("user_id").cast("string").cast("binary")), F.lit(24))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, F.upper(sid)).otherwise(sid).alias("sid")
    )
    good, bad = visitors.split_session_ids(rows, "sid")
    return good.select("event_id", F.lit(True).alias("valid")).union(bad.select("event_id", F.lit(False).alias("valid")))


def link_extract(spark, sf_dir):
    return visitors.extracted_links(table(spark, sf_dir, "documents"), "doc_id", "text")


NAMES = (
    fold_words, stem_tokens, phrase_canon, anchors_numbers, parse_dates, source_rank_hosts, token_df_idf, doc_weights,
    similar_pairs, similar_pairs_context, near_dup_components, cluster_primary, also_reported, already_published_best,
    drop_repeats_fresh, drop_repeats_repeats, exact_repeats, exact_repeats_links, issue_loop_shown, issue_loop_look_back,
    prompt_lines, verdict_parse, verdict_merge, cluster_audit, cluster_pair_quality, benchmark_overlap, page_fields, page_text,
    page_faq, page_knowledge, page_urls, catalogue_urls, knowledge_lines, knowledge_counts, knowledge_document, cards_json, catalogue_json, page_tree,
    published_history, feed_rss, sitemap_unlisted, verdict_fallback, delivery_within, utm_extract, last_touch, first_referrer, click_goals,
    click_files, lead_validation, lead_records, lead_display_texts, sessions_ttl, capped_log, history_context, retry_dedup, error_rollup,
    delivery_status, session_ids, link_extract,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
