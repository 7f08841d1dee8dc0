"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two 32-bit segments. Two fingerprints at two or
fewer differing bits have a segment that differs in at most one bit, so they
share one of that segment's 32 variants with one bit wiped. An equality join
on those variants finds every link.

Only distinct fingerprints enter the index, so exact copies cost nothing. A
variant that more than `bucket` fingerprints share would give a quadratic
number of pairs; its members go to a finer index instead: all 2016 variants of
the whole fingerprint with two bits wiped. Two fingerprints share such a
variant exactly if they differ in two bits or fewer, and at most four
fingerprints can share one. Both ways are exact, and the work for a
fingerprint is bounded however crowded its neighbourhood is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.llm.text import bounded, slices
from eventsieve.operators.components import connected_components
from eventsieve.plans.tables import materialize

BITS = 64
SEGMENT = 32
#: A pair in a shared bucket costs a bit count; the finer index costs 2016 shuffled rows.
BUCKET = 256


def fingerprint_of(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The bits that over half of the shingles' XXH64 hashes have set; 0 for no words."""
    words = (text or b"").lower().split()
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(s, seed) for s in shingles], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, mark, fp) of every row: mark is a hash of the text, fp the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            found = [fingerprint_of(text, width) for _, texts in slices(batch) for text in texts]
            values = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(values)], ["id", "mark", "fp"]
            )

    source = bounded(docs).select(
        docs[id_col].alias("id"),
        F.xxhash64(docs[text_col]).alias("mark"),
        docs[text_col].cast("binary").alias("text"),
    )
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, mark long, fp long")


def _segment_variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 rows a fingerprint, one for each bit wiped within its segment."""
    low = (1 << SEGMENT) - 1
    wiped = [
        (f"(shiftrightunsigned(fp, {SEGMENT * s}) & {low} & ~{1 << j}L) | {(s * SEGMENT + j) << SEGMENT}L")
        for s in range(BITS // SEGMENT)
        for j in range(SEGMENT)
    ]
    return fps.select("fp", F.explode(F.expr(f"array({', '.join(wiped)})")).alias("key"))


def _pair_masks() -> list[int]:
    """Every choice of two of the 64 bits, as signed masks of the bits that stay."""
    full = (1 << BITS) - 1
    masks = [full & ~(1 << i) & ~(1 << j) for i, j in combinations(range(BITS), 2)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: fingerprints of a table with distinct fp whose links connect
    all that differ in two bits or fewer."""
    variants = _segment_variants(fps)
    shared = (
        variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    # Spark sizes a table by what is exploded, not by the 64 rows that come of each, and so would broadcast all of them
    members = materialize(variants.join(shared.hint("merge"), "key"), "variants")
    cold = (
        members.where(F.col("n") <= bucket)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.posexplode("fps").alias("at", "a"), "fps")
        .select(
            "a",
            F.explode(
                F.filter(
                    F.expr("slice(fps, at + 2, greatest(size(fps) - at - 1, 0))"),
                    lambda b: F.bit_count(b.bitwiseXOR(F.col("a"))) <= 2,
                )
            ).alias("b"),
        )
    )
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    fine = (
        crowded.select("fp", F.explode(F.lit(_pair_masks())).alias("mask"))
        .groupBy(F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "mask")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .where("a <> b")
    )
    return cold.union(fine).distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, bucket: int) -> DataFrame:
    """(id, mark, fp, component_id, first) of every row; first is the component's first row by id, then mark."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")
    heads = materialize(prints.groupBy("fp").agg(F.min("id").alias("head"), F.min(row).alias("row")), "heads")
    reached = connected_components(links(heads.select("fp"), bucket), "a", "b")
    least = (
        reached.join(heads, F.col("node") == heads["fp"])
        .groupBy("component")
        .agg(F.min("head").alias("least"), F.min("row").alias("least_row"))
    )
    moved = reached.join(least, "component").select(F.col("node").alias("fp"), "least", "least_row")
    # written out, so that the join below stands alone and a crowded fingerprint can be split
    named = materialize(
        heads.join(moved, "fp", "left").select(
            "fp", F.coalesce("least", "head").alias("component_id"), F.coalesce("least_row", "row").alias("first")
        ),
        "components",
    )
    return prints.join(named, "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    fingerprint has 16 lowercase hex digits; component_id is the smallest id
    reachable over links of two or fewer differing bits, its own included.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id never name a component; a component of such rows only has a
    null component_id. Repeated rows come out as often as they go in; an empty
    table gives an empty result; further columns are ignored.
    """
    return _components(docs, id_col, text_col, bucket).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """The rows of docs that stand first in their component, with their columns.

    First is the least id, rows without one last. Of rows that repeat both id and text one stays. Null and empty texts are
    alike: one of all such rows stays. An empty table gives an empty result; columns may have any name.
    """
    found = _components(docs, id_col, text_col, bucket)
    first = found.where(
        F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    )
    kept = materialize(
        first.groupBy(F.col("id").alias("kept_id"), F.col("mark").alias("kept_mark")).agg(F.count(F.lit(1)).alias("rows")),
        "kept",
    )
    mark = F.xxhash64(docs[text_col])
    rows = docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]) & (mark == kept["kept_mark"]), "left_semi")
    # the second shuffle of texts is for tables with repeated rows only
    return rows if kept.where("rows > 1").isEmpty() else rows.dropDuplicates([id_col, text_col])
