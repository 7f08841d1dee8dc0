"""Importance resampling towards a target distribution.

A text's features are its words and pairs of neighbouring words. Each falls into a bucket by its CRC-32. The buckets of all
documents and those of the target are two distributions; a bucket's gain is the logarithm of their ratio, a document's
weight the mean gain of its features. Adding Gumbel noise, fixed by the document's id, and taking the highest scores
draws documents without replacement in proportion to their weights.

An untrained tokenizers pre-tokenizer, a Split on a regular expression, cuts the ASCII-lowered text into words with offsets. The
windows of neighbouring offset pairs give the features: where one space lies between two words the pair is a slice of the text.
Texts are cut into words once; the buckets of their features, two bytes each, are written and read by the later passes:
one adds up the histogram, one the gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from eventsieve.llm.text import bounded, slices
from eventsieve.plans.tables import materialize

#: What lies between words: ASCII that is no digit and, once lowered, no letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, WIDTH = 10_000, 2
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Text that is cut into words at once; it ends between words.
_PIECE = 1 << 18
_LETTER = bytes(b > 127 or chr(b).isalnum() for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about _PIECE bytes, cut where no word is cut."""
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and _LETTER[text[end - 1]] and _LETTER[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def features(text: bytes | None, splitter: Split, buckets: int = BUCKETS, width: int = WIDTH) -> tuple[int, bytes]:
    """(words, buckets of all features as 16-bit numbers) of one text."""
    crc, found, count, before = zlib.crc32, [], 0, []
    for piece in pieces((text or b"").lower()):
        piece = piece.decode("utf-8", "replace")
        cut = splitter.pre_tokenize_str(piece)
        # offsets count characters; where all are ASCII they are places in the bytes
        raw = piece.encode() if piece.isascii() else None
        now = [raw[begin:end] for _, (begin, end) in cut] if raw is not None else [word.encode() for word, _ in cut]
        count += len(now)
        words, old = before + now, len(before)
        run = list(map(crc, words))
        marks = run[old:]
        for more in range(1, width):
            # the windows of one word more: the CRC of what came before runs on over the space and the word
            run = list(map(crc, words[more:], map(crc, repeat(b" "), run)))
            # those that end before this piece are known
            marks += run[max(old - more, 0) :]
        found.append((np.array(marks, dtype=np.uint32) % buckets).astype("<u2").tobytes())
        before = words[len(words) - width + 1 :] if len(words) >= width else words
    return count, b"".join(found)


def bucketed(texts: DataFrame, text: str, columns: list[str], buckets: int, width: int) -> DataFrame:
    """The columns, n_words, n_features and found: the buckets of all features of a text, two bytes each. Written once."""
    types = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        splitter = Split(Regex(BETWEEN), "removed")
        for batch in batches:
            for at, held in slices(batch, text):
                rows = [features(t, splitter, buckets, width) for t in held]
                own = [batch.column(c).slice(at, len(held)) for c in columns]
                counts = [pa.array([n for n, _ in rows], pa.int64()), pa.array([len(b) // 2 for _, b in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*own, *counts, pa.array([b for _, b in rows], pa.binary())], [*columns, "n_words", "n_features", "found"]
                )

    schema = f"{types}{', ' if types else ''}n_words long, n_features long, found binary"
    return materialize(bounded(texts).mapInArrow(run, schema), "buckets")


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column("found"):
                counts += np.bincount(np.frombuffer(value.as_py(), dtype="<u2"), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    sums = found.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    # one row a bucket
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray, columns: list[str]) -> DataFrame:
    """The columns, n_words, n_features and weight: the floored mean of the gains of a row's features, 0 without any."""
    sent = found.sparkSession.sparkContext.broadcast(gain)
    types = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in (*columns, "n_words", "n_features"))

    def run(batches):
        gain = sent.value
        for batch in batches:
            held = [np.frombuffer(v.as_py(), dtype="<u2") for v in batch.column("found")]
            mean = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in held]
            own = [batch.column(c) for c in (*columns, "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(mean, pa.int64())], [*columns, "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"{types}, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the id alone."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(mark.cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds rank, from 1 for the highest score, to the rows that are drawn; ties by id, then by mark.

    Rows are dealt by ranges of that order, so that each task numbers its own and only the size of each range is summed up.
    """
    able = F.col("n_words") >= least_words
    order = [(~able).asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("mark")]
    dealt = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "scores")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(able).alias("able"))
    # one row a task
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    count = (sizes.agg(F.sum("able")).first()[0] or 0) * percent // 100
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = F.col("before") + F.col("place")
    numbered = dealt.withColumn("place", place).join(before, "part")
    return numbered.withColumn("rank", F.when(able & (rank <= count), rank).cast("long")).drop("part", "place", "before")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    width: int = WIDTH,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(id, mark, n_words, n_features, weight, score, rank) of every row of docs; rank is null for those that aren't drawn.

    Of the rows with at least least_words words percent % are drawn, rounded down: those with the highest scores, ties by id
    (rows without one last), then by mark, a hash of the text. Rows that agree in both are interchangeable. Null and empty texts have no
    features, weight 0, and are never drawn if least_words is over 0. A null id gives the noise of an empty one. Words are read from whole
    texts; bytes that are not UTF-8 count as U+FFFD. Without documents the result is empty; without target texts, or if these have no words,
    every bucket's target share is even. Further columns are ignored, whatever their names. buckets is at most 65536.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    mine = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].cast("binary").alias("text"))
    found = bucketed(mine, "text", ["id", "mark"], buckets, width)
    goal = bucketed(target.select(target[target_text_col].cast("binary").alias("text")), "text", [], buckets, width)
    gain = gains(histogram(found, buckets), histogram(goal, buckets))
    weights = weighed(found, gain, ["id", "mark"])
    return drawn(weights.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), least_words, percent)
