import random
import re

from eventsieve.llm import urlrules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def brute(url, rules, otherwise="allow"):
    after = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", after).group() if after is not None else ""
    path = re.match(r"[^?#]*", after[len(host) :]).group() if after is not None else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else otherwise


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {r.page_id: tuple(r)[1:] for r in urlrules.judged(pages, table).collect()}
    assert found == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_nested_rules_match_brute_force(spark):
    draw = random.Random(4)
    label = lambda: draw.choice(["a", "b", "com", "net", "x\x01y", "www", "a-b", "", "é"])
    host = lambda n: ".".join(label() for _ in range(draw.randint(1, n)))
    path = lambda: "".join("/" + draw.choice(["", "a", "en", "a/b"]) for _ in range(draw.randint(0, 3)))
    rules = {(host(3), path()) for _ in range(60)}
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in sorted(rules)]
    urls = [f"http://{host(5)}{path()}{draw.choice(['', '?q=/a', '#f', '?a#b'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/En/", "a://b://c/d", "http://a.com?x=/en/"]
    check(spark, urls, rules)
    check(spark, urls, RULES)


def test_empty_and_null_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", "x"), (None, None, "y")], "page_id long, url string, host string")
    found = urlrules.judged(pages, none).collect()
    assert len(found) == 3 and all(r.rule is None and r.verdict == "allow" for r in found)
    odd = spark.createDataFrame([(None, "/", "block"), ("a.com", None, "block"), ("a.com", "/", None)], none.schema)
    assert urlrules.judged(pages, odd).where("verdict <> 'allow'").count() == 0
    twice = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block")], none.schema)
    assert urlrules.judged(pages, twice).where("verdict = 'block'").count() == 2
    assert urlrules.judged(pages.limit(0), twice).count() == 0


def test_a_url_that_most_pages_share(spark):
    urls = ["http://www.example.com/en/a"] * 3000 + [None] * 2000 + [f"http://a{i}.net/es/{i}" for i in range(500)]
    check(spark, urls, RULES)


def test_main_path_has_no_python(spark, capsys):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "allow")], "host string, path string, verdict string")
    urlrules.judged(pages, rules).explain()
    plan = capsys.readouterr().out
    assert "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
