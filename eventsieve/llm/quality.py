"""Quality by hashed word n-gram logistic regression.

Features are n-grams of the words of the whole text, hashed into a fixed number
of slots, in three views: the plain words (1 and 2), the words' shapes (1, 2 and 3:
letters and digits by kind, punctuation as it is, runs as one), and whether a
word repeats one of the two before it. Within a view an n-gram's value is its
share of the view. Weights come from follow-the-regularised-leader updates
over a bounded sample of labelled rows; a score is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.llm.text import bounded, hashed, scrambled, slices

SLOTS = 1 << 18
#: Labelled rows that weights are learned from: those with the least hash of their id.
SAMPLE = 8000
PASSES = 4
VIEWS = 6
#: Shares are small numbers; this brings the usual ones near 1.
SCALE = 4.0
_SHAPE = bytes(
    b if b in b" \t\n\v\f\r" else 97 if b > 127 or 97 <= b < 123 else 65 if 65 <= b < 91 else 57 if 48 <= b < 58 else b
    for b in range(256)
)


def _shape(text: bytes | None) -> bytes:
    """Each word with its bytes by kind and runs as one byte."""
    formed = np.frombuffer((text or b"").translate(_SHAPE).translate(_GAPS), dtype=np.uint8)
    return formed[np.flatnonzero(np.diff(formed, prepend=0))].tobytes()


_GAPS = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


def _views(texts: list):
    """(text, slot) of every n-gram, view by view."""
    words, word_ends = hashed(texts)
    shapes, shape_ends = hashed(texts, _shape)
    for number, (hashes, ends, n) in enumerate(
        (
            (words, word_ends, 1),
            (words, word_ends, 2),
            (shapes, shape_ends, 1),
            (shapes, shape_ends, 2),
            (shapes, shape_ends, 3),
        )
    ):
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        size = max(len(hashes) - n + 1, 0)
        at = np.flatnonzero(text[:size] == text[n - 1 :][:size])
        key = np.full(len(at), number + 1, dtype=np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i]
        yield text[at], (scrambled(key) % np.uint64(SLOTS)).astype(np.int64)
    text = np.repeat(np.arange(len(word_ends)), np.diff(word_ends, prepend=0))
    same = np.zeros(len(words), dtype=np.int64)
    for back in (2, 1):
        same[back:][(words[back:] == words[:-back]) & (text[back:] == text[:-back])] = back
    yield text, same


def features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text, slots distinct and ascending."""
    keys, values = [], []
    for text, slot in _views(texts):
        size = np.bincount(text, minlength=len(texts))
        key, count = np.unique(text * SLOTS + slot, return_counts=True)
        keys.append(key)
        values.append(SCALE * count / size[key // SLOTS])
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(where.reshape(-1), weights=np.concatenate(values), minlength=len(key))
    cuts = np.searchsorted(key, np.arange(1, len(texts)) * SLOTS)
    return [(k % SLOTS, v) for k, v in zip(np.split(key, cuts), np.split(value, cuts))]


def scores(texts: list, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 of each text, without listing distinct features."""
    total = np.full(len(texts), bias)
    for text, slot in _views(texts):
        size = np.bincount(text, minlength=len(texts))
        total += SCALE * np.bincount(text, weights=weights[slot], minlength=len(texts)) / np.maximum(size, 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


class Leader:
    """Follow-the-regularised-leader (proximal) for logistic loss; slot SLOTS is the bias."""

    def __init__(self, rate: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0):
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.rate + self.l2)

    def update(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        chance = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        step = (chance - label) * values
        n = self.n[slots]
        self.z[slots] += step - (np.sqrt(n + step * step) - np.sqrt(n)) / self.rate * w
        self.n[slots] = n + step * step


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    passes: int = PASSES,
) -> tuple[np.ndarray, float]:
    """(weights, bias) learned from at most `sample` labelled rows; all 0 without any.

    Rows whose label is neither 0 nor 1, or whose id is null, are passed over; of an id's
    labels the least counts, of its texts the one with the least hash. The sample is one bounded task's work; the driver receives the weights.
    """
    known = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    text = docs[text_col].cast("binary")
    rows = bounded(docs).select(docs[id_col].alias("id"), text.alias("text")).join(F.broadcast(known), "id").select(
        "*", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark")
    )

    def extract(batches):
        for batch in batches:
            for first, texts in slices(batch, most=1 << 20):
                found = features(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(texts)),
                        batch.column("label").slice(first, len(texts)),
                        batch.column("mark").slice(first, len(texts)),
                        pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                        pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    ],
                    ["id", "label", "mark", "slots", "shares"],
                )

    def learn(batches):
        seen = {}
        for batch in batches:
            for key, label, slots, shares in zip(
                batch.column("id").to_pylist(),
                batch.column("label").to_pylist(),
                (np.asarray(x.values) for x in batch.column("slots")),
                (np.asarray(x.values) for x in batch.column("shares")),
            ):
                seen[key] = (label, np.append(slots, SLOTS), np.append(shares, np.float32(1)))
        leader = Leader()
        keys = sorted(seen, key=str)
        for turn in range(passes):
            for i in np.random.default_rng(turn).permutation(len(keys)):
                label, slots, shares = seen[keys[i]]
                leader.update(slots, shares, label)
        found = leader.weights()
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["slot", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    learned = (
        rows.mapInArrow(extract, f"id {kind}, label int, mark long, slots array<int>, shares array<float>")
        # one row an id, the same in each run
        .groupBy("id")
        .agg(F.min_by(F.struct("label", "slots", "shares"), "mark").alias("first"))
        .select("id", "first.*")
        .repartition(1)
        .mapInArrow(learn, "slot long, weight double")
    )
    weights = np.zeros(SLOTS + 1)
    for row in learned.collect():
        weights[row["slot"]] = row["weight"]
    return weights[:SLOTS], float(weights[SLOTS])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row of docs; score is the probability of label 1.

    Whole texts count, whatever their length; null and empty texts get the
    score of no words. Rows come out as often as they go in; an empty table gives an
    empty result; further columns are never read.
    """
    source = bounded(docs).select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = sent.value
        for batch in batches:
            found = [scores(texts, weights, bias) for _, texts in slices(batch, most=1 << 20)]
            score = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
