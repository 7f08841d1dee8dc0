"""Compression of vectors to short codes: product quantisation in whole numbers.

Vectors become integers and are cut into equal parts. Each part position has a codebook, whose entries are refined
in a fixed number of rounds: every part goes to its nearest entry, every entry becomes the floored mean of its parts.

The nearest entry minimises |c|^2 - 2 x.c. The dot products are matrix products of limbs: integers are
broken into limbs so short that a float64 product sums up to less than 2^53 and is exact in any order of
addition; the limbs' products are recombined in int64, and the first minimum wins, so ties go to the lower index. Nothing
depends on the machine, the number of tasks or the order of rows.

A round is one pass over the rows: tasks send sums and counts of each entry, never rows. Codebooks, parts x entries x width
numbers, are all that reaches the driver or is broadcast.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.plans.tables import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
_CHUNK = 2048
#: Sums travel as two numbers, multiples of 2^_LOW and what is left, so that they can't overflow however many rows there are.
_LOW = 20


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float matrices l with values = sum of l[i] << (bits * i); all but the last hold 0 .. 2^bits - 1, the last has the sign."""
    found, rest = [], values.astype(np.int64)
    while rest.size and max(int(rest.max()), -int(rest.min())) >= 1 << bits:
        found.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*found, rest.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact a @ b.T of integer matrices, in int64.

    bits is the length of a limb: the longest that keeps width x 2^bits x 2^bits within 2^53, if not given.
    """
    width = max(a.shape[1], 1)
    bits = bits or (53 - width.bit_length()) // 2
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; of equal ones the first."""
    ranks = (book * book).sum(axis=1)[None, :] - 2 * products(rows, book)
    index = ranks.argmin(axis=1)
    return index, ranks[np.arange(len(rows)), index] + (rows * rows).sum(axis=1)


def whole_parts(table: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, vector) of the rows that take part: floor(scale * x) as longs, the largest long where it is larger."""
    x = table[vector_col].cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.floor(F.lit(scale) * v).cast("long")
    return table.where(x.isNotNull() & finite).select(
        table[id_col].alias("id"), table[label_col].alias("label"), F.transform(x, whole).alias("vector")
    )


def _reach(width: int) -> int:
    """The largest component for which the squared distance of two vectors stays below 2^63."""
    return isqrt(((1 << 63) - 1) // (4 * width))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` integers, with 0 where a vector is shorter, kept within what squared distances of 64 bits allow."""
    sizes, reach = np.diff(column.offsets.to_numpy()), _reach(width)
    flat = np.clip(column.flatten().to_numpy(), -reach, reach)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _first_entries(rows: DataFrame, entries: int, parts: int, width: int) -> np.ndarray:
    """The codebooks to begin with, (part, entry, position): parts of the rows with the least ids; ties by vector, null ids last."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = _matrix(pa.array([r["vector"] for r in first], pa.list_(pa.int64())), width).reshape(len(first), parts, width // parts)
    return whole.transpose(1, 0, 2)


def _refined(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, step = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = sent.value
        low, high = np.zeros_like(books), np.zeros_like(books)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            held = _matrix(batch.column("vector"), width)
            for at in range(0, len(held), _CHUNK):
                for p in range(parts):
                    own = held[at : at + _CHUNK, p * step : (p + 1) * step]
                    index = nearest(own, books[p])[0]
                    np.add.at(low[p], index, own & ((1 << _LOW) - 1))
                    np.add.at(high[p], index, own >> _LOW)
                    counts[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        lists = lambda sums: pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), lists(low), lists(high)],
            ["part", "entry", "n", "low", "high"],
        )

    sums = rows.select("vector").mapInArrow(run, "part int, entry int, n long, low array<long>, high array<long>")
    each = sums.select("part", "entry", "n", F.posexplode(F.arrays_zip("low", "high")).alias("at", "sums"))
    totals = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sums.low").alias("low"), F.sum("sums.high").alias("high"))
    refined = books.copy()
    # parts x entries x width rows at most
    for r in totals.collect():
        refined[r["part"], r["entry"], r["at"]] = ((r["high"] << _LOW) + r["low"]) // r["n"]
    sent.unpersist()
    return refined


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, width: int) -> np.ndarray:
    books = _first_entries(rows, entries, parts, width)
    for _ in range(rounds):
        books = _refined(rows, books, width)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, codes, error) of every row that takes part, codebooks by part, entry and position).

    codes is an array of 0-based entries, one a part; error sums the squared distances of all parts. Vectors that are null or
    hold a null or a component that is not finite are left out. The first codebooks are the parts of the `entries` rows with the
    least ids (fewer rows give fewer entries; ties by vector, null ids last). Vectors shorter than the longest, and the longest if
    it can't be cut evenly, count as padded with 0; components are kept within about 2^30.5 / sqrt(width), so that errors fit 64 bits. Repeated rows are rows of their own. An
    empty table gives an empty result and codebooks without entries. Further columns are ignored, whatever their names.
    """
    rows = materialize(whole_parts(table, id_col, vector_col, label_col, scale), "vectors")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    step = max(-(-longest // parts), 1)
    width = step * parts
    books = codebooks(rows, parts, entries, rounds, width)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches):
        books = sent.value
        for batch in batches:
            held = _matrix(batch.column("vector"), width)
            codes, error = np.zeros((len(held), parts), dtype=np.int32), np.zeros(len(held), dtype=np.int64)
            for at in range(0, len(held), _CHUNK):
                for p in range(parts):
                    codes[at : at + _CHUNK, p], far = nearest(held[at : at + _CHUNK, p * step : (p + 1) * step], books[p])
                    error[at : at + _CHUNK] += far
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)],
                ["id", "label", "codes", "error"],
            )

    coded = rows.mapInArrow(run, f"id {id_type}, label {label_type}, codes array<int>, error long")
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of equal label summed, null labels together; the largest long if the sum is larger."""
    coded = materialize(coded, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long")
    # written, so that the join stands alone and a label that very many rows have can be split
    sums = materialize(coded.groupBy("label").agg(total.alias("label_error")), "errors").withColumnRenamed("label", "sum_label")
    return coded.join(sums, coded["label"].eqNullSafe(sums["sum_label"])).drop("sum_label")
