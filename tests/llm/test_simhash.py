from collections import Counter

import xxhash
from pyspark.sql import functions as F

from eventsieve.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(shingles))


def brute_components(prints):
    """prints: {key: fingerprint}; the least key reachable."""
    least = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprint_is_a_majority_of_shingle_hashes(prose):
    for text in ["", None, "one", "one two", "One TWO three", prose(50, 1), prose(700, 2), "x\x0by\x0cz é"]:
        assert simhash.fingerprint_of(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_components_match_brute_force(spark, prose):
    texts = {}
    for i in range(30):
        words = prose(120, i).split()
        for j in range(4):
            changed = list(words)
            for k in range(j):
                changed[7 * k] = f"new{j}"
            texts[i * 10 + j] = " ".join(changed)
    found = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    expected = brute_components({k: plain_fingerprint(t) for k, t in texts.items()})
    assert {r.doc_id: r.component_id for r in found.collect()} == expected
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) for r in found.collect())


def test_crowded_and_sparse_index_agree(spark):
    base = 0x0F0F_1234_5678_9ABC
    prints = {base ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(20, 40)} | {base, base ^ 7, base ^ 63}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    fps = spark.createDataFrame(signed, "fp long")
    from eventsieve.operators.components import connected_components

    def parts(bucket):
        rows = connected_components(simhash.links(fps, bucket), "a", "b").collect()
        return {(r.node, r.component) for r in rows}

    assert parts(4) == parts(10_000)
    pairs = {(a, b) for a, in signed for b, in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert {(r.a, r.b) for r in simhash.links(fps, 10_000).collect()} == pairs


def test_clashing_names(awkward):
    for name in ("kept_id", "kept_mark", "rows", "id", "fp", "component_id", "first", "head"):
        clash = awkward.withColumnRenamed("mark", name)
        kept = simhash.one_of_each(clash)
        assert kept.columns == clash.columns and kept.count() == 6
        assert simhash.near_duplicates(clash).count() == clash.count()


def test_awkward_rows(awkward, empty):
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].component_id == 1
    # no words: fingerprint zero, all in one component
    assert {by_id[i].fingerprint for i in (3, 4, 6)} == {"0" * 16}
    assert {by_id[i].component_id for i in (3, 4, 6)} == {3}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 7, 8]
    assert simhash.one_of_each(empty).count() == 0
    assert kept.where(F.col("doc_id").isNull()).first().text.startswith("a text")
