import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from eventsieve.functions import lexicon, text, urls
from eventsieve.functions.lexicon import DEFAULT, Lexicon


def values(spark, function, inputs, **options):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"), **options)).collect()]


def test_words_traps(spark):
    cases = {
        "Prices rise, price rates approves": {"pric", "price", "rise", "rate", "approv"},
        "EU's free-trade agreements": {"eu", "fta"},
        "us department of agriculture": {"da"},
        "increased increases": {"increas", "rise"},
        "niño": {"ni"},
        "Рост цен на рис": {"рост", "цен", "рис"},
        "ＦＵＬＬ　width": {"full", "width"},
        "kilotonnes": {"kilo", "mt"},
        "": set(),
    }
    assert [set(w) for w in values(spark, text.words, cases)] == list(cases.values())
    assert values(spark, text.words, [None]) == [[]]
    own = Lexicon(stop_words=("rice",), phrases=(), suffixes=())
    assert values(spark, text.words, ["rice imports"], lexicon=own) == [["imports"]]


def test_phrases_match_plain_rewrites(spark):
    texts = [
        "free - trade deals and free trade", "Tonnes of record-high shipments", "metric ton, metric tonnes", "us department of agriculture",
        "he hikes; a hiker surges, cutback cuts slashed", "35-year high all time high highest", "bangko sentral ng pilipinas", "", "rise é hike",
        "european unions of the european union european union",
    ]
    own = Lexicon(phrases=(("ab?c|d", "<$0>"), ("plain", "[$0]"), (r"(x|y)z", ""), (r"q[r|s]t", "u"), (r"\bone\b|\btwos?\b", "n")))
    odd = ["ac abc d", "plain", "xz yz z", "qrt qst q|t", "one twos ones two"]
    for lexicon, given in ((DEFAULT, texts), (own, odd)):
        chain = F.col("t")
        for pattern, replacement in lexicon.phrases:
            chain = F.regexp_replace(chain, ("(?U)" if "\\" in pattern else "") + pattern, replacement)
        rows = spark.createDataFrame([(t.lower(),) for t in given], "t string").select(chain.alias("plain"), text.with_phrases(F.col("t"), lexicon).alias("got"))
        assert [r.got for r in rows.collect()] == [r.plain for r in rows.collect()]


def test_queries_fold_compatibility_forms(spark, tmp_path):
    from eventsieve import queries

    plain = ["fish office exports 5.5 million units to china", "Café prices rise", None, ""]
    wide = ["\ufb01sh o\ufb03ce exports \uff15.\uff15 million units to \uff43\uff48ina", "Cafe\u0301 prices rise", None, ""]
    shown = []
    for name, texts in (("plain", plain), ("wide", wide)):
        rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        prints = queries._prints(spark, f"{tmp_path}/{name}").orderBy("id").collect()
        canon = queries.phrase_canon(spark, f"{tmp_path}/{name}").orderBy("doc_id").collect()
        shown.append((prints, canon))
    assert shown[0] == shown[1]
    assert "5.5" in shown[1][0][0].nums


@pytest.mark.parametrize("nfkc", [True, False])
def test_anchors(spark, nfkc):
    cases = {
        "$9.11B and 5.7M MT, 27.80%": ["9.11", "5.7", "27.8"],
        "P2.2 billion": [],
        "$2.2 billion": ["2.2"],
        "8 months of 2026, 8% and 8 million": ["8"],
        "1998 million 2,500k": ["2500"],
        "1234567.8 0.00001234%": ["1.23457e+06", "1.234e-05"],
        "100% 0.5 2000.5": ["100", "0.5", "2000.5"],
        "nothing 12": [],
    }
    assert values(spark, text.anchors, cases, nfkc=nfkc) == list(cases.values())


def test_dates(spark):
    day = datetime.date(2026, 9, 17)
    cases = {
        "2026-09-17": day, "17.09.2026": day, " 2026-09-17T10:11:12+03:00": day, "2026-9-17": day, "17.9.2026": day,
        "2026-09-17 10:00": day, "31.02.2026": None, "": None, "soon": None, "2026-09-17T99:00:00": None,
    }
    assert values(spark, text.any_date, cases) == list(cases.values())
    assert values(spark, text.any_date, [None]) == [None]


def test_lead(spark):
    assert values(spark, text.lead, ["  a b\n\tc  ", "a b c d e", None, "   "], count=3) == ["a b c", "a b c", "", ""]


def test_source_rank(spark):
    cases = {
        "https://www.adb.org/news": 0, "http://psa.gov.ph/x": 0, "https://xyzadb.org/": 0, "https://www.msn.com/en": 2,
        "https://news.google.com/gov.ph": 2, "https://example.com/adb.org": 1, None: 1, "https://adb.org?x": 1,
    }
    assert values(spark, urls.source_rank, cases) == list(cases.values())


def test_url_rules(spark):
    assert values(spark, urls.utm, ["http://a/?utm_source=x%20y&utm_medium=&b=1#utm_term=z"]) == [{"utm_source": "x y"}]
    assert values(spark, urls.click_goal, ["MailTo:x", "https://wa.me/1.pdf", "/a.PDF?x", "/a.pdfx", None]) == [
        "email_click", "whatsapp_click", "download", None, None,
    ]
    found = values(spark, urls.links, ["see https://a.b/c). or me@x.org!"])[0]
    assert [tuple(f) for f in found] == [("link", "https://a.b/c"), ("email", "me@x.org")]
    assert values(spark, urls.language, ["ru-RU", "en", None]) == ["ru", "en", "en"]


def test_phrases_equal_plain_patterns(spark):
    """Each pattern alone, against Spark's own replacement of it: guards and boundary rewrites must change nothing."""
    draw = random.Random(8)
    atoms = ["foo", "ba", "r", r"\b", "o?", "a*", "(?:fo|ba)", "(b|(o|a)r)", "[a|b]", "x{0,2}", "ba+", r"\|", r"\\b", r"\s", "zz", " "]
    patterns = ["".join(draw.choices(atoms, k=draw.randint(1, 3))) for _ in range(60)]
    patterns = [p if draw.random() < 0.4 else "|".join([p, *draw.sample(patterns, draw.randint(1, 2))]) for p in patterns]
    patterns += [r"\bfoo|bar\b", r"\bfoo\b|bar\b", r"\bfoo\b|\bbar\b", r"\bfoo\b|\bba(?:r|z)\b", r"\bfoo\\b", r"\b", r"\b\b", "|foo", r"\bfoo\b|"]
    texts = ["".join(draw.choices(["foo", "bar", "baz", "o", " ", "x", "|", "\\b", "b"], k=draw.randint(0, 7))) for _ in range(60)]
    texts += ["foobaz crowbar foo bar", "foo|bar", "", "zz x foo"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wide = lambda p: ("(?U)" if re.search(r"\\[bsw]", p) else "") + p
    mine = [text.with_phrases(F.col("t"), lexicon.Lexicon(phrases=((p, "X"),))) for p in patterns]
    plain = [F.regexp_replace("t", wide(p), "X") for p in patterns]
    for row in rows.select("t", F.array(*mine).alias("mine"), F.array(*plain).alias("plain")).collect():
        assert dict(zip(patterns, row.mine)) == dict(zip(patterns, row.plain)), row.t


def test_lists_are_whole():
    """Counts of the fixed lists, so that a lost or doubled entry shows."""
    assert (len(lexicon.DEFAULT.stop_words), len(set(lexicon.DEFAULT.stop_words)), len(lexicon.DEFAULT.phrases)) == (122, 122, 17)


def test_short_numbers_stand_as_they_are_and_foreign_digits_do_no_harm(spark):
    from pyspark.sql import functions as F

    from eventsieve.functions import text

    told = "0.0% 00.50% 007.10% 0.0001% 0.00009% 1234.56% 12345.67% 999999% 1000000% 100000.0% 50 million 1950% 123456.5% ١٢.٥% 2.50 x"
    found = spark.createDataFrame([(told,)], "t string").select(text.anchors(F.col("t"))).first()[0]
    assert found == ["0", "0.5", "7.1", "0.0001", "9e-05", "1234.56", "12345.7", "999999", "1e+06", "100000", "50", "123457", "2.5"]
