import math
import random
from collections import Counter

import numpy as np

from eventsieve.llm import language

PARTS = {
    "en": "the ing tion er and of th ea re ha".split(),
    "de": "sch ung ein der ch keit ver und ge ß".split(),
    "fr": "eau tion le é ment oi les de ai que".split(),
}


def sentence(lang, seed, words=40):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choices(PARTS[lang], k=draw.randint(1, 4))) for _ in range(words))


def corpus(n=60):
    return [(100 * k + i, sentence(lang, i), lang) for k, lang in enumerate(PARTS) for i in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 5 <> 0"), "doc_id", "text", "lang")
    assert sorted(set(model.langs)) == sorted(PARTS) and len(model.langs) > len(PARTS)
    truth = {i: lang for i, _, lang in corpus()}
    held = language.predicted(docs.where("doc_id % 5 = 0"), model).collect()
    assert all(r.lang_pred == truth[r.doc_id] and not r.rejected and 0 < r.score <= 1 for r in held)
    strange = spark.createDataFrame([(1, "съешь же ещё этих мягких французских булок да выпей чаю " * 5)], "doc_id long, text string")
    assert language.predicted(strange, model).first().rejected
    kept = language.without_rejected(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def plain_vector(text, idf):
    """Trigram by trigram."""
    letters = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    formed = b" " + b" ".join(letters.split()) + b" "
    counts = Counter()
    for i in range(len(formed) - 2):
        gram = int.from_bytes(formed[i : i + 3], "big")
        counts[(gram * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += 1
    vector = np.zeros(language.DIMENSIONS)
    for slot, n in counts.items():
        vector[slot] = math.log(1 + n) * idf[slot]
    return vector / (np.linalg.norm(vector) or 1), counts


def test_matches_a_plain_version(spark):
    rows = corpus(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, "doc_id", "text", "lang")
    seen = Counter(slot for _, text, _ in rows for slot in plain_vector(text, np.ones(language.DIMENSIONS))[1])
    assert np.allclose(model.idf, [math.log((len(rows) + 1) / (seen[i] + 1)) + 1 for i in range(language.DIMENSIONS)])
    assert np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    vectors = {i: plain_vector(text, model.idf) for i, text, _ in rows}
    for lang in PARTS:
        # no text of a language is nearer to the mean of all its texts than to the nearest of its centroids, by far
        own = [vectors[i][0] for i, _, name in rows if name == lang]
        mean = sum(own) / np.linalg.norm(sum(own))
        near = [max(v @ c for c, name in zip(model.centres, model.langs) if name == lang) for v in own]
        assert sum(near) >= sum(v @ mean for v in own)
    for r in language.predicted(docs, model).collect():
        vector, counts = vectors[r.doc_id]
        cosines = model.centres @ vector
        best = int(np.argmax(cosines))
        assert r.lang_pred == model.langs[best] and abs(r.score - cosines[best]) < 1e-5
        far = cosines[best] < language.REJECT_SHARE * model.levels[best] * math.sqrt(len(counts) / (len(counts) + 400))
        assert r.rejected == far


def test_an_odd_language_leaves_the_others_their_level_and_many_are_bounded(spark):
    draw = random.Random(2)
    odd = [(900 + i, "".join(draw.choices("qxzjkvwy ", k=40)), "odd") for i in range(30)]
    docs = spark.createDataFrame(corpus(30) + odd, "doc_id long, text string, lang string")
    model, alone = (language.fit(docs.where(w), "doc_id", "text", "lang") for w in ("true", "lang <> 'odd'"))
    level = lambda m: {n: round(float(x), 1) for n, x in zip(m.langs, m.levels)}
    assert {n: x for n, x in level(model).items() if n != "odd"}.keys() == level(alone).keys()
    assert level(model)["odd"] < min(level(alone).values())
    strange = spark.createDataFrame([(1, "съешь же ещё этих мягких французских булок да выпей чаю " * 5)], "doc_id long, text string")
    assert language.predicted(strange, alone).first().rejected
    dirty = spark.createDataFrame([(i, sentence("en", i), f"l{i // 3}") for i in range(60)], "doc_id long, text string, lang string")
    assert len(set(language.fit(dirty, "doc_id", "text", "lang", languages=5).langs)) == 5


def test_repeated_ids_give_the_same_model(spark):
    rows = corpus(20) + [(3, sentence("en", 500 + i), "en") for i in range(50)]
    models = [
        language.fit(spark.createDataFrame(r, "doc_id long, text string, lang string"), "doc_id", "text", "lang") for r in (rows, rows[::-1])
    ]
    assert models[0].langs == models[1].langs and np.allclose(models[0].centres, models[1].centres)


def test_awkward_rows(awkward, empty):
    model = language.fit(awkward, "doc_id", "text", "lang")
    rows = language.predicted(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.doc_id in (3, 4, 6, 7):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 5)} == {"en"}
    assert language.fit(empty, "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in language.predicted(awkward, None).collect()} == {"und"}
    assert language.predicted(empty, model).count() == 0
    clash = awkward.withColumnRenamed("mark", "letters")
    assert language.without_rejected(clash, model).columns == clash.columns
