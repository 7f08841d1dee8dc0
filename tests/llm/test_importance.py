import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from eventsieve.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, width=2, buckets=10_000):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, tests, least_words=20, percent=25):
    """{(id, text): (n_features, weight, score, rank)}."""
    read = [(i, t, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in read for b in f), Counter(b for x in tests for b in plain_features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = {}
    for i, text, n, found in read:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i, text] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    able = sorted((k for k in out if out[k][4] >= least_words), key=lambda k: (-out[k][2], k[0]))
    for rank, k in enumerate(able[: percent * len(able) // 100]):
        out[k][3] = rank + 1
    return {k: tuple(v[:4]) for k, v in out.items()}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_features_of_awkward_texts(width, monkeypatch):
    splitter = Split(Regex(importance.BETWEEN), "removed")
    texts = [None, "", " ", "one", "One  TWO\n3-three", "é É ß日本語 ａｂｃ a b \U0001f600x_y", "a\x00b\x7fc\x80d`e{f|g~h@i[j^k", "x" * 50, "a b " * 99, "é" * 40]
    for piece in (1 << 18, 7, 1):
        monkeypatch.setattr(importance, "_PIECE", piece)
        for text in texts:
            words, packed = importance.features(text.encode() if text is not None else None, splitter, 10_000, width)
            n, found = plain_features(text, width)
            got = [int.from_bytes(packed[i : i + 2], "little") for i in range(0, len(packed), 2)]
            assert words == n and Counter(got) == Counter(found)


def test_brute_force(spark, prose):
    draw = random.Random(1)
    rows = [(i, prose(draw.choice([0, 1, 19, 20, 21, 60, 200]), i)) for i in range(150)] + [(i, f"Ünï {prose(30, i)} 日本 x-Y_z") for i in range(150, 170)]
    tests = [prose(40, 1000 + i) for i in range(12)] + [rows[60][1], None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(t,) for t in tests], "text string")
    out = importance.resampled(docs, target)
    texts = dict(rows)
    assert {(r.id, texts[r.id]): (r.n_features, r.weight, r.score, r.rank) for r in out.collect()} == brute(rows, tests)


def test_ties_go_to_the_smaller_id_and_ranks_are_whole(spark):
    # three ids whose noise is equal can't be found by hand: equal scores come from equal ids
    rows = [(i // 3, f"{'same word ' * 15}{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("same word",)], "text string")
    out = importance.resampled(docs, target, percent=50).collect()
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 46))
    assert [(-r.score, r.id) for r in ranked] == sorted((-r.score, r.id) for r in out)[:45]


def test_awkward_rows(spark, awkward, empty):
    target = spark.createDataFrame([("the quick brown fox",)], "text string")
    for name in ("id", "rank"):
        docs = awkward.withColumnRenamed("mark", name)
        out = importance.resampled(docs, target, least_words=1, percent=100).collect()
        assert len(out) == docs.count()
        assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 1 + sum(r.n_words > 0 for r in out)))
    by_id = {r.id: r for r in out}
    assert by_id[3].n_features == by_id[4].n_features == by_id[6].n_features == 0 == by_id[4].weight and by_id[3]["rank"] is None
    assert by_id[5].n_features == 2 * 100_000 - 1
    assert importance.resampled(empty, target).count() == 0
    assert importance.resampled(awkward, target.where("false")).count() == awkward.count()
    with pytest.raises(ValueError):
        importance.resampled(awkward, target, buckets=1 << 17)


def test_query_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tests = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = queries.op13_importance(spark, sf)
    assert {c for _, c in out.dtypes} == {"bigint"}
    expected = {k[0]: v for k, v in brute(rows, tests).items()}
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()} == expected
