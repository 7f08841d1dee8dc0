import math

import numpy as np
from pyspark.sql import functions as F

from eventsieve.llm import quality
from eventsieve.llm.text import hashed, plain


def labelled(prose, n=240):
    docs, labels = [], []
    for i in range(n):
        words, good = prose(20 + i % 60, i), i % 3 > 0
        text = words.capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words.split())
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_scores_are_sparse_dot_products(prose):
    texts = [prose(50, 1).encode(), b"", None, b"one", "Ünïcode WORDS!! words words".encode()]
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=quality.SLOTS), 0.25
    direct = []
    for slots, values in quality.features(texts):
        assert len(np.unique(slots)) == len(slots)
        direct.append(1 / (1 + np.exp(-(bias + weights[slots] @ values))))
    assert np.allclose(quality.scores(texts, weights, bias), direct)


def test_word_hashes_follow_words_not_places():
    texts = [b"alpha beta  alpha", b"beta", b"", b"gamma, ALPHA!" * 3]
    hashes, ends = hashed(texts)
    words = [w for t in texts for w in plain(t).split()]
    assert len(hashes) == len(words) and list(ends) == [3, 4, 4, len(words)]
    assert len({(w, h) for w, h in zip(words, hashes)}) == len(set(words)) == len(set(hashes.tolist()))


def test_views_share_out_their_weight(prose):
    text = prose(30, 4).encode()
    (slots, values), (_, none) = quality.features([text, b""])
    # five views of n-grams and one of repeats, each worth SCALE
    assert abs(values.sum() - quality.VIEWS * quality.SCALE) < 1e-9 and len(none) == 0


def test_updates_match_a_plain_version(spark, prose):
    """The same leader, one number at a time."""
    docs, labels = labelled(prose, 200)
    found, bias = quality.fit(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    )
    rate, beta, l1, l2, z, n = 0.3, 1.0, 0.3, 1.0, {}, {}

    def weight(slot):
        if abs(z.get(slot, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[slot] > 0 else -1
        return (sign * l1 - z[slot]) / ((beta + math.sqrt(n[slot])) / rate + l2)

    rows = [(label, quality.features([text.encode()])[0]) for (_, text), (_, label) in zip(docs, labels)]
    order = sorted(range(len(docs)), key=str)
    for turn in range(quality.PASSES):
        for i in np.random.default_rng(turn).permutation(len(order)):
            label, (slots, values) = rows[order[i]]
            pairs = [*zip(slots.tolist(), values.astype(np.float32).tolist()), (quality.SLOTS, 1.0)]
            chance = 1 / (1 + math.exp(-sum(weight(s) * v for s, v in pairs)))
            for s, v in pairs:
                gradient, own = (chance - label) * v, weight(s)
                before = n.get(s, 0.0)
                n[s] = before + gradient * gradient
                z[s] = z.get(s, 0.0) + gradient - (math.sqrt(n[s]) - math.sqrt(before)) / rate * own
    expected = np.zeros(quality.SLOTS + 1)
    for slot in z:
        expected[slot] = weight(slot)
    assert np.allclose(np.append(found, bias), expected, atol=1e-6) and np.count_nonzero(expected) > 3


def test_repeated_ids_give_the_same_model(spark, prose):
    docs, labels = labelled(prose, 30)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = [*docs, *[(i % 7, prose(12, 900 + i)) for i in range(60)]]
    models = [quality.fit(spark.createDataFrame(r, "doc_id long, text string"), known) for r in (rows, rows[::-1])]
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1]


def test_held_out_accuracy(spark, prose):
    docs, labels = labelled(prose)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d, known.where("doc_id % 5 <> 0"))
    found = {r.doc_id: r.score for r in quality.scored(d, model).where("doc_id % 5 = 0").collect()}
    truth = dict(labels)
    assert all((s >= 0.3) == bool(truth[i]) for i, s in found.items())
    again = quality.fit(d, known.where("doc_id % 5 <> 0"))
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]


def test_awkward_rows(spark, awkward, empty):
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    model = quality.fit(awkward, odd)
    rows = quality.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 6)}) == 1
    assert quality.scored(empty, model).count() == 0
    blank = quality.fit(empty, odd.limit(0))
    assert not blank[0].any() and blank[1] == 0
    assert quality.scored(awkward, blank).select(F.max("score")).first()[0] == 0.5
