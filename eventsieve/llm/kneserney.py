"""Log10 probabilities of texts under an interpolated modified Kneser-Ney bigram model.

Counting takes two Spark passes over the training texts. The first counts words
by hash; the second counts pairs of the words' ranks. Tasks combine what they
read into sorted arrays, and one shuffle brings the arrays of a shard together.
A shard's task merges them and writes them to the shared folder: sorted hashes
of words, and sorted packed pairs of ranks, with their counts. A third job sums
what a word needs (its continuations and its followers seen once, twice and more
often). Scoring tasks map these files into memory, so that a worker holds only
the pages it touches, and look words and pairs up by binary search.

The shared folder must be mounted on driver and executors (file: in
spark.checkpoint.dir), as memory mapping needs. Files are written aside and
moved into place, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.llm.text import bounded, hashed, lower_words, scrambled, slices
from eventsieve.plans.tables import shared_path

#: Pairs that a shard may hold on average, and entries that a task gathers before it sends them.
SHARD = 1 << 20
GATHER = 1 << 22
_MOST_WORD_SHARDS, _MOST_PAIR_SHARDS = 1 << 12, 1 << 18


# -- arrays that travel and arrays on disk


def _packed(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Ascending keys as differences, bytes by place, compressed; then the counts, likewise."""
    columns = [np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), *(c.astype(np.uint64) for c in counts)]
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=size * 8 * columns, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(columns, 8, size)
    found = [np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes]
    return [np.cumsum(found[0]), *found[1:]]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal keys as one, their counts summed."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    counts = [np.concatenate([p[i] for p in parts])[order] for i in range(1, len(parts[0]))]
    return [keys[first], *(np.add.reduceat(c, first) if len(first) else c for c in counts)]


def _sent(keys, counts, shard_of) -> pa.RecordBatch:
    """One row for each shard that has some of the ascending keys."""
    shard = shard_of(keys)
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)
    cuts = np.split(order, starts[1:]) if len(names) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int64)), pa.array([_packed(keys[c], *(x[c] for x in counts)) for c in cuts], pa.binary())],
        ["shard", "blob"],
    )


def _save(path: str, array: np.ndarray) -> None:
    aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(aside, "wb") as f:
        np.save(f, array)
    os.replace(aside, path)


class Files:
    """Arrays of one folder, each mapped into memory when first asked for. A file that isn't there is an error: it was lost."""

    def __init__(self, folder: str):
        self.folder, self.known = folder, {}

    def __call__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.known[name]


def mounted_path(spark) -> str:
    parts = urlsplit(shared_path(spark, "kneserney"))
    if parts.scheme not in ("", "file"):
        raise ValueError("the model's files are memory-mapped: spark.checkpoint.dir must be a mounted folder")
    os.makedirs(parts.path, exist_ok=True)
    return parts.path


def _power(n: float, most: int) -> int:
    """The power of two at or above n, from 16 to most."""
    return min(most, max(16, 1 << max(0, int(np.ceil(n)) - 1).bit_length()))


# -- words


def _tokens(texts: list):
    """(text, hash) of the words of all texts, in order; and the words of each."""
    hashes, ends = hashed(texts, lower_words)
    sizes = np.diff(ends, prepend=0)
    return np.repeat(np.arange(len(texts)), sizes), hashes, sizes


def _count_words(source: DataFrame, folder: str, shards: int) -> list:
    """Writes words-<shard> (ascending hashes) and uses-<shard>; (shard, words, tokens, texts) of each."""
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def gather(batches):
        held, size, texts_seen = [], 0, 0
        shard_of = lambda keys: keys >> shift
        for batch in batches:
            for _, texts in slices(batch):
                texts_seen += len(texts)
                held.append(list(np.unique(hashed(texts, lower_words)[0], return_counts=True)))
                size += len(held[-1][0])
                if size > GATHER:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > GATHER // 2:
                        yield _sent(held[0][0], held[0][1:], shard_of)
                        held, size = [], 0
        if held:
            keys, counts = _merged(held)
            yield _sent(keys, [counts], shard_of)
        # the number of texts travels as a shard of its own
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int64()), pa.array([texts_seen.to_bytes(8, "little")], pa.binary())], ["shard", "blob"]
        )

    def merge(rows: pa.Table) -> pa.Table:
        shard, blobs = rows["shard"][0].as_py(), rows["blob"].to_pylist()
        if shard < 0:
            found = (shard, 0, 0, sum(int.from_bytes(b, "little") for b in blobs))
        else:
            keys, counts = _merged([_unpacked(b, 2) for b in blobs])
            _save(f"{folder}/words-{shard}.npy", keys)
            _save(f"{folder}/uses-{shard}.npy", counts)
            found = (shard, len(keys), int(counts.sum()), 0)
        return pa.table({n: [v] for n, v in zip(("shard", "words", "tokens", "texts"), found)})

    sent = source.select("text").mapInArrow(gather, "shard long, blob binary")
    return sent.groupBy("shard").applyInArrow(merge, "shard long, words long, tokens long, texts long").collect()


class Words:
    """Ranks and counts of words; END and BEGIN follow the last rank."""

    def __init__(self, folder: str, shards: int, begins: dict[int, int], size: int):
        self.files, self.shards, self.begins, self.size = Files(folder), shards, begins, size
        self.end, self.begin, self.span = size, size + 1, size + 2

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, count) of ascending hashes."""
        ranks, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        shard = (hashes >> np.uint64(64 - (self.shards.bit_length() - 1))).astype(np.int64)
        for name, at in zip(*np.unique(shard, return_index=True)):
            if name not in self.begins:
                continue
            upto = np.searchsorted(shard, name, side="right")
            known = self.files(f"words-{name}")
            place = np.searchsorted(known, hashes[at:upto])
            place[place == len(known)] = 0
            hit = known[place] == hashes[at:upto]
            ranks[at:upto][hit] = self.begins[name] + place[hit]
            counts[at:upto][hit] = self.files(f"uses-{name}")[place[hit]]
        return ranks, counts


# -- pairs


def _sequence(text: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, words: Words):
    """(text, before, token) of every word and every end."""
    ends = np.cumsum(sizes)
    token = np.insert(ranks, ends, words.end)
    of = np.insert(text, ends, np.arange(len(sizes)))
    before = np.roll(token, 1)
    before[np.concatenate([[0], (ends + np.arange(1, len(sizes) + 1))[:-1]])] = words.begin
    return of, before, token


def _count_pairs(source: DataFrame, folder: str, parts: tuple, shards: int) -> DataFrame:
    """Writes pairs-<shard> and seen-<shard>; rows (shard, blob) of what each word gains from them.

    The blob holds, for each word, its continuations and the number of its followers seen once, twice and
    more often; shard -1 - s has the number of pairs seen 1, 2, 3 and 4 times in s, and of all.
    """
    mask = np.uint64(shards - 1)
    shard_of = lambda keys: scrambled(keys) & mask

    def gather(batches):
        words, held, size = Words(*parts), [], 0
        for batch in batches:
            for _, texts in slices(batch):
                text, hashes, sizes = _tokens(texts)
                distinct, where = np.unique(hashes, return_inverse=True)
                ranks = words(distinct)[0][where.reshape(-1)]
                _, before, token = _sequence(text, sizes, ranks, words)
                keys = before.astype(np.uint64) * np.uint64(words.span) + token.astype(np.uint64)
                held.append(list(np.unique(keys, return_counts=True)))
                size += len(held[-1][0])
                if size > GATHER:
                    keys, counts = _merged(held)
                    yield _sent(keys, [counts], shard_of)
                    held, size = [], 0
        if held:
            keys, counts = _merged(held)
            yield _sent(keys, [counts], shard_of)

    ranges = _ranges(parts)

    def merge(rows: pa.Table) -> pa.Table:
        words, shard = Words(*parts), rows["shard"][0].as_py()
        keys, counts = _merged([_unpacked(b, 2) for b in rows["blob"].to_pylist()])
        _save(f"{folder}/pairs-{shard}.npy", keys)
        _save(f"{folder}/seen-{shard}.npy", counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
        before, token = keys // np.uint64(words.span), keys % np.uint64(words.span)
        one = np.ones(len(keys), dtype=np.uint64)
        none = one * np.uint64(0)
        gains = _merged(
            [
                [token, one, none, none, none],
                [before, none, *(x.astype(np.uint64) for x in (counts == 1, counts == 2, counts > 2))],
            ]
        )
        found = _sent(gains[0], gains[1:], lambda k: k // np.uint64(ranges))
        often = [np.array([(counts == i).sum() for i in range(1, 5)] + [len(keys)])]
        blob = _packed(np.arange(5), *often)
        return pa.Table.from_batches(
            [
                found,
                pa.RecordBatch.from_arrays([pa.array([-1 - shard]), pa.array([blob], pa.binary())], ["shard", "blob"]),
            ]
        )

    sent = source.select("text").mapInArrow(gather, "shard long, blob binary")
    return sent.groupBy("shard").applyInArrow(merge, "shard long, blob binary")


def _ranges(parts: tuple) -> int:
    """Ranks that one task of the last counting job takes."""
    return max(1 << 18, -(-(parts[3] + 2) // 4096))


GAINS = ("continues", "once", "twice", "often")


def _count_gains(gains: DataFrame, folder: str, parts: tuple) -> list:
    """Writes the arrays named in GAINS by rank, one file a range of ranks; rows of count-of-counts and of the shards there are."""
    span, ranges = parts[3] + 2, _ranges(parts)

    def merge(rows: pa.Table) -> pa.Table:
        shard, blobs = rows["shard"][0].as_py(), rows["blob"].to_pylist()
        if shard < 0:
            sums = [int(x) for x in _merged([_unpacked(b, 2) for b in blobs])[1]]
            held = [-1 - s for s in rows["shard"].to_pylist()]
        else:
            held = [shard]
            keys, *sums = _merged([_unpacked(b, 5) for b in blobs])
            first = shard * ranges
            for name, values in zip(GAINS, sums):
                whole = np.zeros(min(ranges, span - first), dtype=np.uint32 if values.max() < 1 << 32 else np.uint64)
                whole[keys.astype(np.int64) - first] = values
                _save(f"{folder}/{name}-{shard}.npy", whole)
            sums = [int((sums[0] == i).sum()) for i in range(1, 5)] + [int((sums[0] > 0).sum())]
        table = {"pairs": [shard < 0], "held": pa.array([held], pa.list_(pa.int64()))}
        return pa.table(table | {f"c{i}": [v] for i, v in enumerate(sums, 1)})

    schema = "pairs boolean, held array<long>, c1 long, c2 long, c3 long, c4 long, c5 long"
    tagged = gains.withColumn("to", F.when(F.col("shard") < 0, F.lit(-1)).otherwise(F.col("shard")))
    return tagged.groupBy("to").applyInArrow(merge, schema).collect()


# -- the model


def discounts(often: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from the numbers of entries seen 1 to 4 times.

    Where one of those numbers is 0, as in tiny inputs, they are 0.5, 1 and 1.5.
    """
    if min(often) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = often[0] / (often[0] + 2 * often[1])
    found = [k - (k + 1) * y * often[k] / often[k - 1] for k in (1, 2, 3)]
    return np.array([0, *(min(max(d, 0.05), k) for k, d in enumerate(found, 1))])


def fit(training: DataFrame, text_col: str = "text") -> dict:
    """Counts the model from the texts of a table (null: empty); what scoring needs to find its files.

    Every text adds its words and one end. An empty table gives a model without
    words. Further columns are ignored.
    """
    spark = training.sparkSession
    folder = mounted_path(spark)
    source = bounded(training).select(training[text_col].cast("binary").alias("text"))
    word_shards = _power(source.rdd.getNumPartitions(), _MOST_WORD_SHARDS)
    found = sorted(_count_words(source, folder, word_shards))
    texts = sum(r["texts"] for r in found)
    begins, size, tokens = {}, 0, texts
    for row in found:
        if row["shard"] >= 0:
            begins[row["shard"]] = size
            size += row["words"]
            tokens += row["tokens"]
    if size + 2 > 1 << 32:
        raise ValueError("pairs of ranks are packed in 64 bits: 2^32 different words at most")
    parts = (folder, word_shards, begins, size)
    pair_shards = _power(tokens / SHARD, _MOST_PAIR_SHARDS)
    rows = _count_gains(_count_pairs(source, folder, parts, pair_shards), folder, parts) if texts else []
    total = lambda pairs: [sum(r[f"c{i}"] for r in rows if r["pairs"] == pairs) for i in range(1, 6)]
    return {
        "parts": parts,
        "shards": pair_shards,
        "texts": texts,
        "tokens": tokens,
        "words": size + bool(texts),
        "held": {s for r in rows if r["pairs"] for s in r["held"]},
        "ranges": _ranges(parts),
        "pairs": total(True),
        "continued": total(False),
    }


class Scorer:
    """Scores runs of texts; made in each task from what fit() returned."""

    def __init__(self, model: dict):
        self.model, self.words = model, Words(*model["parts"])
        self.files = self.words.files
        self.pair_cut, self.word_cut = discounts(model["pairs"][:4]), discounts(model["continued"][:4])
        n = model["continued"]
        freed = self.word_cut[1:] @ [n[0], n[1], n[4] - n[0] - n[1]]
        self.all_pairs = max(model["pairs"][4], 1)
        self.unseen = (freed / self.all_pairs if model["texts"] else 1.0) / (model["words"] + 1)

    def _seen(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        shard = (scrambled(keys) & np.uint64(self.model["shards"] - 1)).astype(np.int64)
        order = np.lexsort((keys, shard))
        names, starts = np.unique(shard[order], return_index=True)
        counts = np.zeros(len(keys), dtype=np.int64)
        for name, own in zip(names, np.split(order, starts[1:]) if len(names) else []):
            if name not in self.model["held"]:
                continue
            known = self.files(f"pairs-{name}")
            place = np.searchsorted(known, keys[own])
            place[place == len(known)] = 0
            hit = known[place] == keys[own]
            counts[own[hit]] = self.files(f"seen-{name}")[place[hit]]
        return counts

    def _gained(self, name: str, ranks: np.ndarray) -> np.ndarray:
        """The values of ascending ranks in an array named in GAINS."""
        part = ranks // self.model["ranges"]
        shards, starts = np.unique(part, return_index=True)
        cut = np.split(ranks, starts[1:]) if len(shards) else []
        found = [self.files(f"{name}-{s}")[own - s * self.model["ranges"]].astype(np.float64) for s, own in zip(shards, cut)]
        return np.concatenate(found) if found else np.empty(0)

    def __call__(self, texts: list) -> list[np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        model, words = self.model, self.words
        text, hashes, sizes = _tokens(texts)
        distinct, where = np.unique(hashes, return_inverse=True)
        where = where.reshape(-1)
        ranks, counts = words(distinct)
        of, before, token = _sequence(text, sizes, np.where(ranks < 0, -1, ranks)[where], words)
        ends = np.cumsum(sizes)
        uses = np.insert(counts[where], ends, model["texts"])
        log = np.log10((uses + 1) / (model["tokens"] + model["words"] + 1))
        by_text = lambda values: np.bincount(of, weights=values, minlength=len(texts))
        chance = np.full(len(token), self.unseen)
        if model["texts"]:
            known = token >= 0
            # words repeat: look each one up once
            mine, at = np.unique(np.concatenate([token[known], before[before >= 0]]), return_inverse=True)
            own = {name: self._gained(name, mine) for name in GAINS}
            at = at.reshape(-1)
            follows = own["continues"][at[: known.sum()]]
            cut = self.word_cut[np.minimum(follows, 3).astype(np.int64)]
            chance[known] += np.maximum(follows - cut, 0) / self.all_pairs
            led = before >= 0
            lead = at[known.sum() :]
            freed = self.pair_cut[1] * own["once"] + self.pair_cut[2] * own["twice"] + self.pair_cut[3] * own["often"]
            total = np.roll(uses, 1).astype(np.float64)
            total[before == words.begin] = model["texts"]
            both = led & known
            pair = before[both].astype(np.uint64) * np.uint64(words.span) + token[both].astype(np.uint64)
            keys, back = np.unique(pair, return_inverse=True)
            seen = np.zeros(len(token))
            seen[both] = self._seen(keys)[back.reshape(-1)]
            cut = self.pair_cut[np.minimum(seen, 3).astype(np.int64)]
            mixed = np.maximum(seen - cut, 0)
            mixed[led] = (mixed[led] + freed[lead] * chance[led]) / total[led]
            chance = np.where(led, mixed, chance)
        return [
            sizes + 1,
            by_text(uses > 0).astype(np.int64),
            by_text(log),
            by_text(np.log10(chance)),
        ]


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    score is the text's log10 probability, its end included; the text's
    perplexity is 10^(-score / n_tokens). base_score is that of single words
    with one added to each count. Null counts as empty: one end. Whole texts
    count. Rows come out as often as they go in; an empty table gives an empty
    result; further columns are ignored.
    """
    source = bounded(docs).select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer(texts) for _, texts in slices(batch)]
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0)] * 4
            tokens, known, base, score = columns
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(tokens.astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(np.full(len(tokens), model["tokens"], dtype=np.int64)),
                    pa.array(base),
                    pa.array(score),
                ],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
