import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventsieve.llm import mixing


def brute_targets(sizes):
    """sizes: {source: words}; the excess over three times a source's size is shared again until none is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def brute_copies(spark, rows, found, seed=42, most=3.0, long=64):
    """{id: copies}: prefix sums of the expected copies along the sizes of a source, longest first, with its one offset."""
    target = {r.source: (r.target, r.source_size) for r in found}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    out = {}
    for source, (goal, size) in target.items():
        offset = spark.range(1).select(F.pmod(F.xxhash64(F.lit(seed), F.lit(source).cast("string")), F.lit(1 << 20))).first()[0] / (1 << 20)
        own = sorted((i for i, _, s in rows if s == source), key=lambda i: (-words[i], i is not None, i or 0))
        big = [i for i in own if words[i] * long > size]
        steps, left, rest = 0.0, goal, float(size)
        for i in big:
            after = steps + min(max(left / rest, 0.0), most)
            out[i] = math.floor(after + offset) - math.floor(steps + offset)
            steps, left, rest = after, left - words[i] * out[i], rest - words[i]
        step = min(max(left / rest, 0.0), most) if rest > 0 and big else min(goal / size, most) if size else 0.0
        for at, i in enumerate(own[len(big) :], 1):
            out[i] = math.floor(steps + at * step + offset) - math.floor(steps + (at - 1) * step + offset)
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += words[i]
    targets = brute_targets(sizes)
    taken = Counter()
    for r in found:
        assert r.size == words[r.doc_id] and r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        longest = max(words[i] for i, _, t in rows if t == s)
        assert abs(taken[s] - targets[s]) <= longest + 1e-6
    assert {r.doc_id: r.copies for r in found} == brute_copies(spark, rows, found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).collect()))
    return found


def test_small_sources_with_long_documents_stay_near_their_target(spark, prose):
    rows, n = [], 0
    for source, lengths in (("a", [900, 300, *range(5, 45)]), ("b", [200] * 3 + [20] * 12), ("c", [400, *range(1, 60)]), ("d", list(range(10, 90)))):
        for words in lengths:
            rows.append((n, prose(words, n), source))
            n += 1
    found = check(spark, rows)
    for source, shortest in (("a", 45), ("b", 20), ("c", 59), ("d", 90)):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= shortest


def test_targets_and_words_taken(spark, prose):
    rows, n = [], 0
    for source, count, words in (("a", 120, 9), ("b", 30, 40), ("é", 3, 2), (None, 50, 15), ("Z", 200, 30)):
        for k in range(count):
            rows.append((n, prose(1 + (k * 7) % words, n), source))
            n += 1
    check(spark, rows)


def test_all_targets_at_their_cap_and_sources_without_words(spark):
    found = check(spark, [(1, "a b c", "x"), (2, None, "y"), (3, "", "y"), (4, "d", "z")])
    assert {r.target for r in found if r.source == "y"} == {0.0}


@pytest.mark.parametrize("name", ["copy", "mix_id", "mix_mark", "mix_source", "mix_copies", "rows", "size", "target", "step", "part"])
def test_clashing_names(spark, prose, name):
    docs = spark.createDataFrame([(i, prose(9, i), "s", "x") for i in range(12)], f"doc_id long, text string, source string, {name} string")
    out = mixing.emitted(docs)
    assert out.columns == [*docs.columns, "copy_" if name == "copy" else "copy"]
    assert len(set(out.columns)) == 5 and out.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_awkward_rows(awkward, empty):
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mix(empty).count() == 0
    assert mixing.emitted(empty).count() == 0
    out = mixing.emitted(awkward)
    assert out.columns == [*awkward.columns, "copy"]
    assert out.count() == sum(r.copies for r in mixing.mix(awkward).collect())
