"""Line de-duplication: lines that stand in many documents stay in one of them.

Texts are exploded into lines. A line's key is the line without white space (0x20, 0x09-0x0D) at both ends
and with A-Z lower-cased; keys travel as 128-bit hashes. The different documents of each hash are counted, hashes
over the threshold name the positions to drop, and each text that loses lines is put together again
from the stretches between these positions.

Only DataFrame functions are used. Counting first brings a key and a document together once, then adds up with
map-side combine, so a key that a third of all documents hold is no hot group. The keys over the threshold are written before they are
joined, so that Spark sees their true size and can split a hot key. The texts themselves are shuffled once, by
document, and never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsieve.plans.tables import materialize

LEAST_CHARS = 40
LEAST_DOCS = 5
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """The line without white space around it, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANK))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hash(text: Column) -> Column:
    """128 bits, as two longs."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def marks(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, row, pos, key) of every line whose key is long enough; row is a hash of the whole text."""
    found = docs.select(
        docs[id_col].alias("id"), _hash(F.coalesce(docs[text_col], F.lit(""))).alias("row"), F.posexplode(_lines(docs[text_col])).alias("pos", "line")
    )
    # the test of the raw line spares keys of lines that are too short before anything is cut off
    keyed = found.where(F.char_length("line") >= least_chars).select("id", "row", "pos", _key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= least_chars).select("id", "row", "pos", _hash(F.col("key")).alias("key"))


def frequent(held: DataFrame, least_docs: int) -> DataFrame:
    """(key, keeper) of the keys that least_docs documents or more hold; keeper is the largest of their ids."""
    once = held.where("id is not null").select("key", "id").distinct()
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least_docs).select("key", "keeper")


def _kept(text: Column, drops: Column) -> Column:
    """The lines of a text without those at the ascending positions of drops, joined again.

    Each stretch between two positions is cut out once, so long texts cost no more than their length.
    """

    def joined(s: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), s["drops"], F.array(F.size(s["lines"])))
        between = F.transform(
            F.sequence(F.lit(1), F.size(s["drops"]) + 1), lambda i: F.slice(s["lines"], F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1)
        )
        return F.array_join(F.flatten(between), "\n")

    # one element, so that the text is split once
    return F.transform(F.array(F.struct(_lines(text).alias("lines"), drops.alias("drops"))), joined)[0]


def without_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """docs with two further columns, n_lines and n_dropped, and texts without the lines that many documents share.

    Texts are split at \\n; a null or empty text is one empty line. Keys of at least least_chars code points that at least
    least_docs different ids hold lose all their lines, except in the rows of the largest of these ids, which keep all of theirs.
    n_lines counts lines before dropping. Rows that share an id are one document: they count once, and each has its own lines
    kept or dropped. Rows without an id hold no line for others: they don't count and never keep. Null texts come out as empty ones.
    Repeated rows come out as often as they go in; an empty table gives an empty result. Where docs has columns n_lines or
    n_dropped, the new names get underscores until they are free.
    """
    held = marks(docs, id_col, text_col, least_chars)
    shared = materialize(frequent(held, least_docs), "frequent")
    lost = held.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    # written, so that the join below stands alone and a row that repeats very often can be split
    drops = materialize(
        lost.groupBy(F.col("id").alias("drop_id"), F.col("row").alias("drop_row")).agg(F.sort_array(F.collect_set("pos")).alias("drops")), "drops"
    )
    n_lines = _free("n_lines", docs.columns)
    n_dropped = _free("n_dropped", docs.columns)
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(drops["drop_id"]) & (_hash(text) == drops["drop_row"])
    rest = F.when(drops["drops"].isNull(), text).otherwise(_kept(text, drops["drops"]))
    return docs.join(drops, same, "left").select(
        *[rest.alias(c) if c == text_col else docs[c] for c in docs.columns],
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias(n_lines),
        F.coalesce(F.size(drops["drops"]), F.lit(0)).cast("long").alias(n_dropped),
    )
