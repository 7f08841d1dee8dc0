import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from eventsieve.llm import mixing
from tests.llm.test_contamination import brute as leaks
from tests.llm.test_language import sentence
from tests.llm.test_mixing import brute_copies
from tests.llm.test_simhash import brute_components, plain_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def tables(spark, tmp_path):
    draw, docs = random.Random(8), []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        docs.append([i, sentence(lang, i, 60), lang, draw.choice(["s1", "s2", None])])
    item = sentence("en", 999, 25)
    docs += [[100 + i, docs[i][1], docs[i][2], "s1"] for i in range(10)]  # exact copies
    docs += [[200, f"{sentence('en', 500)} {item} {sentence('en', 501)}", "en", "s2"]]
    docs += [[300, f"{sentence('de', 600)} token = \"{'0a1b' * 8}\" end", "de", "s2"]]
    docs += [[400, None, "en", "s1"], [401, "", "en", "s1"], [402, "123 456", None, "s1"], [None, sentence("fr", 700), "fr", "s2"]]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, item


def test_run_matches_a_plain_version(spark, tables):
    folder, rows, item = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    found = out.collect()
    worded = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    groups = brute_components({i if i is not None else 10**9: plain_fingerprint(t) for i, t in worded.items()})
    kept = {i for i in worded if groups[i if i is not None else 10**9] == (i if i is not None else 10**9)}
    kept = {i for i in kept if not leaks(worded[i], item)}
    assert 200 not in kept and 300 in kept
    shown = {i: t if i != 300 else t.replace('token = "' + "0a1b" * 8, "[SECRET]") for i, t in worded.items() if i in kept}
    rest = {i: (lang, s) for i, _, lang, s, _ in rows}
    mixed = mixing.mix(spark.createDataFrame([(i, t, rest[i][1]) for i, t in shown.items()], "doc_id long, text string, source string"))
    copies = brute_copies(spark, [(i, t, rest[i][1]) for i, t in shown.items()], mixed.collect())
    expected = [(i, t, *rest[i], len(t), c) for i, t in shown.items() for c in range(1, copies[i] + 1)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("mark", F.lit(1)).withColumn("spans", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, folder)
            assert out.columns == docs.columns + ["copy"] * (name == "mixing"), name
            assert (out.count() == 0) == (table is not docs), name


def test_registered_queries():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        assert len([q for q in found if q.startswith(f"op{n}_")]) == 1
