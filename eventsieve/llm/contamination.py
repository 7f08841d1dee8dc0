"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects from a stretch; the
other positions may differ. Both masks together hit every stretch of 13 words
in which at most two are substituted; two more, for items of 8 to 12 words, hit every
such item in which 80 % of the words are equal. Items of 5 to 7 words, of which one may be substituted, have a mask for each of
their words, which ignores that word; of still fewer words 80 % are all of them, and the item is a seed of its own. Training seeds are compared with test
seeds by an equi-join; before it, a bit table of fixed size that holds the test
seeds drops nearly all that cannot match, so the shuffle follows the hits and
not the corpus. Around each hit the two texts are aligned and compared word by
word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.llm.text import bounded, hashed, scrambled, slices
from eventsieve.plans.tables import materialize

#: Word positions that count; the others may be substituted.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: More masks for items of fewer than WINDOW words: with those above they leave no placement of the substitutions unseen.
SHORT_MASKS = ((0, 1, 2, 4, 5), (0, 1, 7, 8, 9))
#: Words of the narrowest mask; items of fewer words than SHORTEST have masks of their own, which ignore one word from LOOSE words on.
SPAN, SHORTEST, LOOSE = 6, 8, 5
WINDOW = 13
SIMILARITY = 0.8
#: log2 of the bits in the table of test seeds: 8 MB whatever the benchmark's size.
TABLE_BITS = 26
_CHUNK = 1 << 15


def _seed(hashes: np.ndarray, offsets, number: int, size: int) -> np.ndarray:
    """The hash of the words at the offsets, from each of `size` positions."""
    seed = np.full(size, number + 1, dtype=np.uint64)
    for k, offset in enumerate(offsets):
        seed += hashes[offset : offset + size] * np.uint64(2 * (0x9E3779B1 + 97 * k) ** 2 + 1)
    return scrambled(seed)


def _seeds(hashes: np.ndarray, ends: np.ndarray, short: np.ndarray):
    """(text, position, seed) of every mask at every position that lies within one text; SHORT_MASKS in the texts that are short."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for number, mask in enumerate(MASKS + SHORT_MASKS if short.any() else MASKS):
        size = len(hashes) - mask[-1]
        if size <= 0:
            continue
        inside = text[:size] == text[mask[-1] :]
        at = np.flatnonzero(inside & short[text[:size]] if number >= len(MASKS) else inside)
        yield text[at], at, _seed(hashes, mask, number, size)[at]


def _phrases(hashes: np.ndarray, ends: np.ndarray, words: int):
    """(text, position, seed) of every run of `words` words: one seed of all, or from LOOSE words on one for each word that is ignored."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    size = max(len(hashes) - words + 1, 0)
    at = np.flatnonzero(text[:size] == text[words - 1 :][:size])
    for ignored in range(words) if words >= LOOSE else (words,):
        mask = [k for k in range(words) if k != ignored]
        yield text[at], at, _seed(hashes, mask, len(MASKS + SHORT_MASKS) + SHORTEST * words + ignored, size)[at]


def _around(hashes, ends, text, at, window: int, filler: int) -> np.ndarray:
    """The words from window - SPAN before each position to window after it, filler beyond the text."""
    wide = 2 * window - SPAN
    places = at[:, None] - (window - SPAN) + np.arange(wide)[None, :]
    first = (ends - np.diff(ends, prepend=0))[text][:, None]
    inside = (places >= first) & (places < ends[text][:, None])
    return np.where(inside, hashes[np.clip(places, 0, len(hashes) - 1)], np.uint64(filler))


def _rows(ids, text, seed, around, extra=()):
    flat = pa.array(around.reshape(-1).view(np.int64))
    wide = around.shape[1]
    offsets = pa.array(np.arange(0, len(around) * wide + 1, wide, dtype=np.int32))
    return [ids.take(pa.array(text)), pa.array(seed.view(np.int64)), pa.ListArray.from_arrays(offsets, flat), *extra]


def test_seeds(tests: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(item, seed, theirs, need) of distinct test texts; need is the window, or the whole item if shorter."""

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch, most=1 << 20):
                hashes, ends = hashed(texts)
                size = np.diff(ends, prepend=0)
                need = np.minimum(size, window).astype(np.int32)
                short = (size >= SHORTEST) & (need < WINDOW)
                ids = batch.column("id").slice(first, len(texts))
                whole = [
                    tuple(x[size[text] == words] for x in (text, at, seed))
                    for words in range(1, SHORTEST) if (size == words).any()
                    for text, at, seed in _phrases(hashes, ends, words)
                ]
                for text, at, seed in (*_seeds(hashes, ends, short), *whole):
                    around = _around(hashes, ends, text, at, window, 1)
                    yield pa.RecordBatch.from_arrays(
                        _rows(ids, text, seed, around, [pa.array(need[text])]),
                        ["item", "seed", "theirs", "need"],
                    )

    once = tests.select(
        tests[id_col].alias("id"), tests[text_col].cast("binary").alias("text")
    ).groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    kind = once.schema["id"].dataType.simpleString()
    return once.mapInArrow(run, f"item {kind}, seed long, theirs array<long>, need int")


def seed_table(seeds: DataFrame, bits: int = TABLE_BITS) -> tuple[np.ndarray, list[int]]:
    """A bit for each value of a seed's low bits that occurs, 2^bits bits in all; and the needs that occur."""
    low = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    width = 1 << 15
    parts = (
        seeds.select(F.floor(low / width).alias("part"), (low % width).alias("bit"), "need")
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"), F.collect_set("need").alias("needs"))
    )
    needs = set()
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in parts.toLocalIterator():
        table[row["part"] * (width >> 3) :][: width >> 3] = np.frombuffer(row["bits"], dtype=np.uint8)
        needs.update(row["needs"])
    return table, sorted(needs)


def hits(docs: DataFrame, table, needs: list[int], window: int, bits: int = TABLE_BITS) -> DataFrame:
    """(id, mark, seed, ours) of the training seeds of docs (id, mark, text) that the table holds; of the masks that needs ask for."""
    short, phrases = any(SHORTEST <= n < WINDOW for n in needs), [n for n in needs if n < SHORTEST]

    def run(batches):
        known = table.value
        for batch in batches:
            for first, texts in slices(batch, most=1 << 20):
                hashes, ends = hashed(texts)
                ids = batch.column("id").slice(first, len(texts))
                marks = batch.column("mark").slice(first, len(texts))
                masked = _seeds(hashes, ends, np.full(len(ends), short))
                for words, (text, at, seed) in [*((0, x) for x in masked), *((n, x) for n in phrases for x in _phrases(hashes, ends, n))]:
                    low = seed & np.uint64((1 << bits) - 1)
                    held = np.flatnonzero(known[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    if words and len(held):
                        # what stands around doesn't matter: each run of words once a text is enough
                        runs = _seed(hashes, range(words), 0, len(hashes) - words + 1)[at[held]]
                        held = held[np.unique(np.column_stack([text[held], runs.view(np.int64)]), axis=0, return_index=True)[1]]
                    for i in range(0, len(held), _CHUNK):
                        kept = held[i : i + _CHUNK]
                        around = _around(hashes, ends, text[kept], at[kept], window, 0)
                        columns = _rows(ids, text[kept], seed[kept], around)
                        columns.insert(1, marks.take(pa.array(text[kept])))
                        yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "seed", "ours"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, mark long, seed long, ours array<long>")


def _verified(pairs: DataFrame, kind: str, item_kind: str, window: int, similarity: float) -> DataFrame:
    """Pairs with the largest share of equal words over a window, where it reaches similarity."""
    wide = 2 * window - SPAN

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ours, theirs = (
                np.asarray(batch.column(c).flatten()).reshape(-1, wide) for c in ("ours", "theirs")
            )
            need = np.asarray(batch.column("need"))
            sums = np.pad(np.cumsum(ours == theirs, axis=1), ((0, 0), (1, 0)))
            share = np.zeros(len(need))
            for size in np.unique(need):
                own = need == size
                share[own] = (sums[own, size:] - sums[own, :-size]).max(axis=1) / size
            good = pa.array(np.flatnonzero(share >= similarity))
            columns = [batch.column(c).take(good) for c in ("id", "mark", "item")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(share).take(good)], ["id", "mark", "item", "share"])

    return pairs.select("id", "mark", "item", "ours", "theirs", "need").mapInArrow(
        run, f"id {kind}, mark long, item {item_kind}, share double"
    )


def overlaps(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    window: int = WINDOW,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, mark, items, item, share): the documents that hold test text.

    A document holds a test item if a stretch of `window` of the item's words
    (the whole item if it is shorter) stands in it, with at least `similarity` of the
    words equal at their places. With the default window and similarity none is missed.
    That lets items of fewer than 5 words stand there only unchanged. Case and ASCII punctuation don't count.
    mark is a hash of the
    text: it tells rows of equal or null ids apart. items counts the distinct items found,
    item is the one with the largest share (ties: the least id). Test texts
    that repeat count once, under their least id. Null and empty texts on
    either side match nothing; empty tables give an empty result; further
    columns are ignored.
    """
    if window < SHORTEST:
        raise ValueError(f"a window has {SHORTEST} words at least")
    session = docs.sparkSession
    # both sides of the join below are plain tables, so that a seed that many texts share can be split
    seeds = materialize(test_seeds(tests, test_id, test_text, window), "seeds")
    held, needs = seed_table(seeds)
    table = session.sparkContext.broadcast(held)
    source = bounded(docs).select(
        docs[id_col].alias("id"),
        F.xxhash64(docs[text_col]).alias("mark"),
        docs[text_col].cast("binary").alias("text"),
    )
    pairs = hits(source, table, needs, window).join(seeds, "seed")
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((source, "id"), (seeds, "item")))
    found = _verified(pairs, kind, item_kind, window, similarity)
    best = found.groupBy("id", "mark", "item").agg(F.max("share").alias("share"))
    # a null id last: the least of what there is
    rank = F.struct((-F.col("share")).alias("share"), F.col("item").isNull().alias("unnamed"), "item")
    return best.groupBy("id", "mark").agg(
        F.count(F.lit(1)).cast("int").alias("items"),
        F.min_by("item", rank).alias("item"),
        F.max("share").alias("share"),
    )


def judged(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, contaminated, items, best_item, share) of every row of docs; see overlaps().

    A row without a text, or with an empty one, is clean. Rows come out as often as they go in; an empty table gives an
    empty result, one of tests leaves all rows clean; further columns are ignored.
    """
    # written, so that the join stands alone and a row that repeats very often can be split
    found = materialize(overlaps(docs, tests, id_col, text_col, **options).withColumnRenamed("id", "other"), "overlaps")
    mine = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("own"))
    return mine.join(found, F.col("id").eqNullSafe(F.col("other")) & (F.col("own") == F.col("mark")), "left").select(
        F.col("id").alias(id_col),
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.lit(0)).alias("items"),
        F.col("item").alias("best_item"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


def without_tests(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no test text, with their columns, whatever these are called.

    Rows without a text, or with an empty one, stay; of repeated rows all stay or all go. An empty table of tests leaves docs
    as it is.
    """
    found = materialize(overlaps(docs, tests, id_col, text_col, **options).select("id", "mark"), "leaks")
    same = docs[id_col].eqNullSafe(found["id"]) & (F.xxhash64(docs[text_col]) == found["mark"])
    return docs.join(found, same, "left_anti")
