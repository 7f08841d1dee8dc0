import textwrap

import numpy as np

from eventsieve.llm import licences
from eventsieve.llm.text import hashed

APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public\nLicense as published by the Free Software Foundation; either version 2 of the License, or (at your option) any\nlater version."


def test_detection_and_inheritance(spark, prose):
    files = [
        (1, "a/LICENSE", APACHE),
        (2, "a/x.py", prose(50, 1)),
        (3, "a/b/c/y.py", prose(50, 2)),
        (4, "a/b/COPYING.txt", f"{prose(30, 3)}\n{GPL}\n{prose(30, 4)}"),
        (5, "a/b/c/z.py", f"{prose(200, 5)} {APACHE.upper()}!! {prose(100, 6)}"),
        (6, "d/e.py", prose(50, 7)),
        (7, None, "Released under the MIT License."),
        (8, None, prose(20, 8)),
        (9, "./a//b/c/d/w.py", None),
        (10, "a/b.py/LICENSES", ""),
        (11, "top.py", prose(20, 9)),
    ]
    found = {r.doc_id: r for r in licences.licensed(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert len(found) == len(files)
    told = {k: (r.licence, r.origin, r.licence_path) for k, r in found.items()}
    assert told[1] == ("Apache-2.0", "own", None) and told[5] == ("Apache-2.0", "own", None)
    assert told[2] == ("Apache-2.0", "inherited", "a/LICENSE")
    assert told[3] == told[9] == ("GPL-2.0", "inherited", "a/b/COPYING.txt")
    assert told[4] == ("GPL-2.0", "own", None)
    assert told[7] == ("MIT", "own", None)
    assert told[10] == ("Apache-2.0", "inherited", "a/LICENSE")
    assert told[6] == told[8] == told[11] == (None, None, None)


def test_every_template_names_itself(spark):
    rows = [(i, f"f{i}", text) for i, (_, text) in enumerate(licences.TEMPLATES)]
    filler = [(100 + i, f"g{i}", f"plain filler number {i} of the text") for i in range(200)]
    files = spark.createDataFrame(rows + filler, "doc_id long, path string, text string")
    found = {r.doc_id: r for r in licences.licensed(files).collect()}
    for i, (name, _) in enumerate(licences.TEMPLATES):
        assert found[i].licence == name
        assert found[i].similarity > 0.8
    assert all(found[100 + i].licence is None for i in range(200))


def test_no_licence_is_taken_for_another(spark, prose):
    """Every notice as it is, wrapped with comment marks, and next to other text."""
    wrap = lambda t: "\n".join(f" * {line}" for line in textwrap.wrap(t, 60))
    texts = [f(t, i) for i, (_, t) in enumerate(licences.TEMPLATES) for f in (lambda t, i: t, lambda t, i: wrap(t), lambda t, i: f"{prose(60, i)}\n\n{wrap(t)}\n\n{prose(60, 99 + i)}")]
    found = detected(spark, texts)
    wrong = {(licences.TEMPLATES[i // 3], i % 3): found[i] for i in found if found[i] != licences.TEMPLATES[i // 3][0]}
    assert not wrong


def test_a_template_of_everyday_words_is_found(spark, prose):
    texts = ["Free for any use.", f"{prose(30, 1)}\nFree for any use.\n{prose(30, 2)}", prose(50, 3)]
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "concat('f', doc_id) AS path", "text")
    found = licences.detected(files, "doc_id", "path", "text", templates=(("X", "Free for any use."),)).collect()
    assert [r.licence for r in sorted(found, key=lambda r: r.id)] == ["X", "X", None]


def detected(spark, texts):
    files = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licences.licensed(files.selectExpr("doc_id", "concat('f', doc_id) AS path", "text"))
    return {r.doc_id: r.licence for r in found.collect()}


def test_a_notice_in_every_file(spark, prose):
    for count in (1, 19, 25, 30):
        texts = [f"{APACHE}\n{prose(40, i)}" for i in range(count)]
        assert set(detected(spark, texts).values()) == {"Apache-2.0"}, count
    changed = "Licensed under the Apache Software License, Version 2.0."
    assert set(detected(spark, [f"{prose(20, i)}\n{changed}" for i in range(30)]).values()) == {"Apache-2.0"}


def test_a_notice_in_a_third_of_the_files(spark, prose):
    for notice, name in ((APACHE, "Apache-2.0"), (GPL, "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")):
        texts = [f"{prose(9, i)}\n{notice}\n{prose(9, i + 1)}" if i % 3 == 0 else f"the version of {prose(9, i)}" for i in range(1000)]
        found = detected(spark, texts)
        assert all(found[i] == (name if i % 3 == 0 else None) for i in range(1000)), name


def test_notices_in_few_and_many_of_few_and_many_files(spark, prose):
    """Every planted notice is found whatever its share of the files: recall 1."""
    for total in (10, 2000):
        for share in (0.01, 0.05, 0.3, 1.0):
            count = max(1, int(total * share))
            texts = [f"{prose(12, i)}\n{APACHE}" if i < count else prose(15, i) for i in range(total)]
            found = detected(spark, texts)
            assert {i for i, name in found.items() if name == "Apache-2.0"} == set(range(count)), (total, share)
            assert all(found[i] is None for i in range(count, total))


def test_no_stretch_of_whole_lines_scores_above_what_is_found(spark, prose):
    """Cosines of all runs of whole words against all templates, one by one, on a few short files."""
    known = licences.Templates()
    texts = [f"{prose(6, i)} {t}" for i, (_, t) in enumerate(licences.TEMPLATES) if len(t.split()) < 12] + [prose(12, 90), ""]
    encoded = [t.encode() for t in texts]
    hashes = [hashed([t])[0] for t in encoded]
    places = [licences._places(known.words, h) for h in hashes]
    files = np.array([sum((p == w).any() for p in places) for w in range(len(known.words))])
    match = licences.Matcher(known, files, len(texts))
    best, _ = match(encoded, licences.SIMILARITY)
    for i, place in enumerate(places):
        top = (0.0, None)
        for a in range(len(place)):
            for b in range(a + 1, len(place) + 1):
                run = place[a:b]
                vector = np.bincount(run[run >= 0], minlength=len(known.words)) * match.idf
                if not vector.any():
                    continue
                length = np.sqrt((vector**2).sum() + (run < 0).sum() * vector.max() ** 2 / max(1, 1))
                cosine = match.templates @ vector / length
                top = max(top, (float(cosine.max()), known.names[int(np.argmax(cosine))]), key=lambda x: x[0])
        assert (top[1] if top[0] >= licences.SIMILARITY else None) == (known.names[best[i]] if best[i] >= 0 else None), texts[i]


def test_awkward_rows(awkward, empty):
    from pyspark.sql import functions as F

    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert licences.licensed(awkward.withColumn("path", path)).count() == awkward.count()
    assert licences.licensed(empty.withColumn("path", path)).count() == 0
