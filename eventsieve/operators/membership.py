"""Membership sketches: bitmaps that tell which marks can't have been seen before.

A mark's hash names one bit. A mark whose bit isn't set was never put in; one whose bit is set very likely was, which a join
then confirms. A sketch is a table of bitmaps of 4 KB, so it is built and extended by aggregates, and may be kept
from run to run. It has 16 bits a mark, up to 2^29 bits (64 MB) in all, so it can be broadcast whatever was put in; beyond some 500 million marks
it holds back fewer, and the results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, as Spark's bitmap functions have them.
CHUNK = 1 << 15
PER_MARK = 16
MOST_BITS = 1 << 29


def bits_for(marks: int) -> int:
    """The size of a sketch for so many marks: a power of two."""
    return min(max(1 << (PER_MARK * marks - 1).bit_length() if marks else 0, CHUNK), MOST_BITS)


def _place(mark_hash: str, bits: int) -> Column:
    return F.pmod(F.col(mark_hash), F.lit(bits).cast("long"))


def sketch(hashes: DataFrame, bits: int, mark_hash: str = "h") -> DataFrame:
    """(chunk, size, bitmap) of the hashes, 64-bit numbers; no row for chunks without any. Nulls are passed over."""
    place = hashes.where(F.col(mark_hash).isNotNull()).select(_place(mark_hash, bits).alias("place"))
    chunk = F.expr(f"int(place div {CHUNK})").alias("chunk")
    bitmap = F.bitmap_construct_agg(F.expr(f"place % {CHUNK}")).alias("bitmap")
    return place.groupBy(chunk).agg(F.lit(bits).cast("long").alias("size"), bitmap)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketch of all that two sketches of one size hold."""
    return a.unionByName(b).groupBy("chunk").agg(F.max("size").alias("size"), F.bitmap_or_agg("bitmap").alias("bitmap"))


def likely(rows: DataFrame, seen: DataFrame, bits: int, mark_hash: str = "h") -> DataFrame:
    """The rows whose mark may be in the sketch `seen` of size bits, without a shuffle. Rows without a hash go."""
    # rows travel in a struct, so that their names can't clash
    placed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), _place(mark_hash, bits).alias("place"))
    placed = placed.withColumn("at", F.expr(f"int(place div {CHUNK})"))
    byte = f"int(conv(hex(substring(bitmap, int(place % {CHUNK}) div 8 + 1, 1)), 16, 10))"
    # at most MOST_BITS / 8 bytes
    found = placed.join(F.broadcast(seen.select("chunk", "bitmap")), F.col("at") == F.col("chunk"))
    return found.where(F.expr(f"getbit({byte}, int(place % 8)) = 1")).select("row.*")
