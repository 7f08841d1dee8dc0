import math
import re
from collections import Counter, defaultdict

import numpy as np

from eventsieve.llm import kneserney

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sequence(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


class Brute:
    def __init__(self, texts):
        self.uses, self.pairs, self.texts = Counter(), Counter(), len(texts)
        for t in map(sequence, texts):
            self.uses.update(t)
            self.pairs.update(zip(["<"] + t, t))
        self.n, self.v = sum(self.uses.values()), len(self.uses)
        self.continues = Counter(w for _, w in self.pairs)
        self.followers = defaultdict(Counter)
        for (a, _), c in self.pairs.items():
            self.followers[a][min(c, 3)] += 1
        often = lambda counts: [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        self.cut, self.word_cut = kneserney.discounts(often(self.pairs)), kneserney.discounts(often(self.continues))
        self.all = max(len(self.pairs), 1)
        freed = sum(self.word_cut[min(c, 3)] for c in self.continues.values())
        self.unseen = (freed / self.all if texts else 1) / (self.v + 1)

    def chance(self, a, w):
        low = self.unseen
        if w in self.continues:
            c = self.continues[w]
            low += max(c - self.word_cut[min(c, 3)], 0) / self.all
        total = self.texts if a == "<" else self.uses[a] if a in self.uses else 0
        if not total:
            return low
        c = self.pairs[a, w]
        freed = sum(self.cut[k] * n for k, n in self.followers[a].items())
        return (max(c - self.cut[min(c, 3)], 0) + freed * low) / total

    def row(self, text):
        t = sequence(text)
        base = sum(math.log10((self.uses[w] + 1) / (self.n + self.v + 1)) for w in t)
        score = sum(math.log10(self.chance(a, w)) for a, w in zip(["<"] + t, t))
        return len(t), sum(w in self.uses for w in t), self.n, base, score


def check(spark, docs, training):
    schema = "doc_id long, text string"
    model = kneserney.fit(spark.createDataFrame(training, schema))
    brute = Brute([t for _, t in training])
    found = kneserney.scored(spark.createDataFrame(docs, schema), model).collect()
    assert len(found) == len(docs)
    truth = dict(docs)
    for r in found:
        expected = brute.row(truth[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == expected[:3]
        assert np.allclose([r.base_score, r.score], expected[3:], rtol=1e-9), truth[r.doc_id]
    return brute


def test_matches_brute_force_and_sums_to_one(spark, prose):
    docs = [(i, " ".join(w for w in prose(80, i).split() if i % 3 or len(w) < 5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "Never SEEN words\x0bhere " + prose(5, 3)), (103, prose(5, 3).upper())]
    brute = check(spark, docs, docs[:40] + [(100, None), (101, "")])
    for a in ["<", *list(brute.uses)[:20]]:
        total = sum(brute.chance(a, w) for w in brute.uses) + brute.chance(a, "never seen")
        if a is not None:
            assert abs(total - 1) < 1e-9


def test_arrays_survive_the_journey():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    counts = np.arange(len(keys)).astype(np.uint64)
    for size in (0, 1, len(keys)):
        back = kneserney._unpacked(kneserney._packed(keys[:size], counts[:size]), 2)
        assert np.array_equal(back[0], keys[:size]) and np.array_equal(back[1], counts[:size])


def test_tiny_and_empty_training(spark):
    check(spark, [(1, "a b"), (2, None)], [(1, "a a")])
    check(spark, [(1, "a b"), (2, None)], [(1, None)])
    check(spark, [(1, "a b"), (2, None)], [])


def test_a_lost_file_is_an_error_and_no_silent_zero(spark, prose):
    import os

    import pytest

    model = kneserney.fit(spark.createDataFrame([(i, prose(60, i)) for i in range(20)], "doc_id long, text string"))
    folder = model["parts"][0]
    texts = [prose(60, i).encode() for i in range(20)]
    for name in ("pairs-", "seen-", "words-", "uses-", "continues-", "once-", "twice-", "often-"):
        files = [f for f in os.listdir(folder) if f.startswith(name)]
        moved = [(f"{folder}/{f}", f"{folder}/gone-{f}") for f in files]
        for a, b in moved:
            os.rename(a, b)
        with pytest.raises(FileNotFoundError):
            kneserney.Scorer(model)(texts)
        for a, b in moved:
            os.rename(b, a)
    assert len(kneserney.Scorer(model)(texts)[3]) == 20


def test_awkward_rows(awkward, empty):
    model = kneserney.fit(awkward)
    rows = kneserney.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 6)} == {1}
    assert kneserney.scored(empty, model).count() == 0
